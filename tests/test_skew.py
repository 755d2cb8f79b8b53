"""A third of all rows on one key: results stay whole and equal to the balanced form."""

import datetime as dt

from pyspark.sql import functions as F

from cohortshare.operators import deid, ledger as lg
from cohortshare.schemas import REQUEST


def test_hot_asset_ledger(spark):
    n = 3000
    rows = []
    for s in range(n):
        aid = "hot" if s % 3 == 0 else f"a{s % 50}"
        op = "create" if s < 150 else ["read", "grant", "exists"][s % 3]
        rows.append((s, f"Org{s % 4}MSP", op, aid, None, None, f"Org{(s // 7) % 4}MSP", dt.datetime(2024, 1, 1)))
    reqs = spark.createDataFrame(rows, REQUEST)
    res = lg.apply_requests(reqs.repartition(16, "id"))
    out = res.results
    assert out.count() == n and out.select("seq").distinct().count() == n
    base = {r.seq: r.status for r in lg.apply_requests(reqs).results.collect()}
    assert {r.seq: r.status for r in out.collect()} == base
    hot = [r for r in res.assets.collect() if r.id == "hot"]
    assert len(hot) == 1 and hot[0].owner == "Org0MSP"


def test_hot_class_deid(spark):
    df = spark.range(9000).select(
        F.col("id").cast("string").alias("patient_id"),
        F.when(F.col("id") % 3 == 0, F.lit(30.0)).otherwise((F.col("id") % 400).cast("double")).alias("age_months"),
        F.when(F.col("id") % 3 == 0, F.lit("Hot, X")).otherwise(F.concat(F.lit("C"), (F.col("id") % 7).cast("string")))
        .alias("location"),
        F.lit("2024-05-01").alias("diagnosis_date"), (F.col("id") * 1.0).alias("lab_value"))
    res = deid.deidentify(df, key="patient_id", salt="s")
    rep = res.report.first()
    kept = res.data.count()
    assert rep.records_in == 9000 and rep.records_out == kept
    assert res.data.where(F.col("location") == "Hot").count() == 3000
    res.release()


def test_hot_term_mapping(spark):
    from cohortshare.operators import terms as tm
    from cohortshare.sources.vocab import default_vocab
    rows = [("戈谢氏病" if i % 3 == 0 else ["庞贝病", "abc", "法布雷", f"x{i % 50}"][i % 4], i) for i in range(6000)]
    df = spark.createDataFrame(rows, "term string, rid long").repartition(12)
    out = tm.map_terms(df, default_vocab(spark))
    got = out.collect()
    assert len(got) == 6000 and len({r.rid for r in got}) == 6000
    hot = {(r.code, r.score) for r in got if r.term == "戈谢氏病"}
    assert hot == {("ORPHA:355", 0.82)}
