import math

import pytest
from pyspark.sql import functions as F

from cohortshare.operators import deid


SCHEMA = "patient_id string, ward string, age_months double, location string, diagnosis_date string, lab_value double"


def _ward(spark):
    """Twelve children of one town and month, ages 61 to 71 months, with seven distinct readings."""
    rows = [(f"w-{i}", "east" if i < 5 else "west", 61.0 + min(i, 10), "Graz, Styria", f"2019-08-{i + 2:02d}", 4.0 + 0.25 * (i % 7))
            for i in range(12)]
    return spark.createDataFrame(rows, SCHEMA)


def test_generalisation_of_one_ward(spark):
    rows = deid.apply_generalisation(_ward(spark)).collect()
    assert {(r.location, r.diagnosis_date, r.age_months_gen) for r in rows} == {("Graz", "2019-08", "[60,72)")}
    assert sorted(r.age_months for r in rows)[0] == 61.0 and {r.ward for r in rows} == {"east", "west"}   # other columns stay


def test_report_of_one_ward(spark):
    res = deid.deidentify(_ward(spark), key="patient_id", salt="s")
    rep = res.report.first()
    assert (rep.records_in, rep.records_out, rep.classes_out) == (12, 12, 1)
    assert rep.reid_risk == round(100 / 12, 4) and rep.reid_risk <= 100 / deid.K
    assert rep.information_loss == 100.0                      # 12 months against a span of 10, at most 100
    assert res.data.count() == 12


def test_generalise_edge_values(spark):
    df = spark.createDataFrame(
        [(None, None, None), (float("nan"), "   ", "2021-0"), (-1.0, ",x", "2021-03"),
         (0.0, "Beijing", "2021-03-01"), (11.99, "Shanghai，Pudong, CN", "")],
        "age_months double, location string, diagnosis_date string")
    g = [tuple(r) for r in deid.apply_generalisation(df).select("age_months_gen", "location", "diagnosis_date").collect()]
    assert g == [("*", "*", "*"), ("*", "*", "*"), ("[-12,0)", "", "2021-03"), ("[0,12)", "Beijing", "2021-03"),
                 ("[0,12)", "Shanghai，Pudong", "*")]


def test_k_boundary_and_empty(spark):
    rows = [(f"a{i}", 1.0, "X", "2020-01-01", float(i)) for i in range(5)] + \
           [(f"b{i}", 13.0, "X", "2020-01-01", float(i)) for i in range(4)]
    df = spark.createDataFrame(rows, "patient_id string, age_months double, location string, diagnosis_date string, lab_value double")
    kept = deid.enforce_k_anonymity(deid.apply_generalisation(df))
    assert sorted(r.patient_id for r in kept.collect()) == [f"a{i}" for i in range(5)]
    empty = df.where(F.lit(False))
    rep = deid.deidentify(empty).report.first()
    assert rep.reid_risk == 0.0 and rep.information_loss == 0.0 and rep.records_out == 0


def test_laplace_constant_and_all_null_columns(spark):
    df = spark.createDataFrame([(i, 5.0, None) for i in range(2000)], "k long, lab_value double, other double")
    out = deid.laplace_noise(df, ["lab_value", "other"], 1.0, key="k", salt="t").collect()
    noise = [r.lab_value - 5.0 for r in out]
    assert all(r.other is None for r in out)              # entirely missing: unchanged
    mean_abs = sum(abs(x) for x in noise) / len(noise)
    assert abs(sum(noise) / len(noise)) < 0.15            # mean ~ 0
    assert abs(mean_abs - 1.0) < 0.1                       # constant column: sensitivity 1.0 -> E|noise| = b = 1
    assert all(math.isfinite(x) for x in noise)


def test_keyed_noise_is_partitioning_independent(spark):
    df = spark.range(500).withColumn("lab_value", F.col("id") * 1.0)
    a = deid.laplace_noise(df.repartition(3), key="id", salt="z").orderBy("id").collect()
    b = deid.laplace_noise(df.repartition(7), key="id", salt="z").orderBy("id").collect()
    assert a == b


def test_bounds_clip_and_fix_scale(spark):
    df = spark.createDataFrame([(1, 100.0), (2, -50.0)], "k long, lab_value double")
    out = deid.laplace_noise(df, key="k", salt="s", bounds={"lab_value": (0.0, 10.0)}).collect()
    assert len(out) == 2


def test_standalone_loss_and_risk(spark):
    df = _ward(spark)
    anon = deid.enforce_k_anonymity(deid.apply_generalisation(df))
    assert deid.information_loss(df).first().information_loss == 100.0
    assert deid.reidentification_risk(anon).first().reid_risk == round(100 / 12, 4)
    assert deid.reidentification_risk(anon.where(F.lit(False))).first().reid_risk == 0.0
    wide = spark.createDataFrame([(0.0,), (120.0,)], "age_months double")
    assert deid.information_loss(wide).first().information_loss == 10.0


def test_keyed_noise_needs_a_salt(spark):
    with pytest.raises(ValueError, match="salt"):
        deid.laplace_noise(_ward(spark), key="patient_id")
    with pytest.raises(ValueError, match="salt"):
        deid.deidentify(_ward(spark), key="patient_id")


@pytest.mark.parametrize("how", [{"key": "id", "salt": "s"}, {"seed": 7}])
def test_columns_draw_apart(spark, how):
    df = spark.range(1000).select("id", F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    rows = deid.laplace_noise(df, ["a", "b"], **how).collect()
    assert sum(r.a == r.b for r in rows) == 0
    assert abs(sum((r.a > 0) == (r.b > 0) for r in rows) / 1000 - 0.5) < 0.08
