import random

from pyspark.sql import functions as F

from cohortshare.operators import ledger as lg
from cohortshare.schemas import LEDGER_STATE, REQUEST


def _log(spark, rng, n):
    ops = ["create", "init", "grant", "read", "exists", None]
    rows = [(rng.choice([None, rng.randrange(200000)]) if rng.random() < 0.1 else i * 977, rng.choice(["A", "B", None]), rng.choice(ops),
             rng.choice([None, *(f"x{k}" for k in range(40))]), f"h{i}", f"d{i}", rng.choice(["A", "B", None]), None) for i in range(n)]
    rows = [r if r[3] is None or int(r[3][1:]) % 4 else (*r[:2], "read" if r[2] == "init" else r[2], *r[3:]) for r in rows]
    return spark.createDataFrame(rows + rows[:20], REQUEST).repartition(4)


def test_single_anchors_by_join_equal_the_ordered_lookup(spark):
    reqs = _log(spark, random.Random(8), 400)
    anchors = lg._anchors(reqs, None)
    per_id = [r["count"] for r in anchors.where("id is not null and aseq is not null").groupBy("id").count().collect()]
    assert 1 in per_id and max(per_id) > 1
    rows = lambda df: sorted(map(str, df.select(*lg.ASKED, "a").collect()))
    assert rows(lg._with_anchor(reqs, anchors)) == rows(lg._as_of(reqs, anchors))


def test_rows_kept_for_results_carry_no_payload_and_the_state_is_read_once(spark):
    reqs = _log(spark, random.Random(9), 60).where("id is not null and seq is not null")
    state = spark.createDataFrame([("x1", "A", "h", "d", ["A"], None, 5000)],
                                  "id string, owner string, data_hash string, description string, access_list array<string>, ts timestamp, last_seq long")
    state = state.select(*[F.col(f.name).cast(f.dataType) for f in LEDGER_STATE.fields])
    res = lg.apply_requests(reqs, state=state)
    assert res.cached[0].columns == [*lg.ASKED, "a"]
    assert res.cached[0].schema["a"].dataType.names == ["aseq", "owner"]
    assert len(res.cached) == 4 and all(d.storageLevel.useMemory for d in res.cached)
    plan = res.results._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation") >= 2
    assert res.results.count() == reqs.count()
    kept = {r.id: r.data_hash for r in res.state.collect()}
    assert kept["x1"] == (reqs.where("id = 'x1' and op = 'init' and seq > 5000").orderBy(F.desc("seq")).select("data_hash").first() or ["h"])[0]
    res.release()
