import random

import pyarrow as pa
from pyspark.sql import functions as F

from cohortshare.functions import islands, span_sets
from cohortshare.operators import bio

ROW = "k string, start int, end int, type string"


def _rows(rng, n):
    def one():
        start = rng.choice([None, rng.randrange(3), rng.randrange(20000)])
        end = rng.choice([None, 5, (start or 0) + rng.randrange(4), (start or 0) + 100000, -3])
        return rng.choice([None, "a", "b"]), start, end, rng.choice([None, "DIS", "", "SYM"])
    rows = [one() for _ in range(n)]
    return rows + rows[: n // 2]


def _want(g, p):
    return len(set(g)), len(set(p)), len(set(g) & set(p))


def test_entity_prf_compares_sets(spark):
    rng = random.Random(3)
    g, p = _rows(rng, 700), _rows(rng, 500)
    p += g[::3]
    gold, pred = (spark.createDataFrame(x, ROW).repartition(5) for x in (g, p))
    got = bio.entity_prf(gold, pred, keys=("k",)).first()
    assert (got.n_gold, got.n_pred, got.tp) == _want(g, p)
    no_key = bio.entity_prf(gold, pred, keys=()).first()
    assert (no_key.n_gold, no_key.n_pred, no_key.tp) == _want([x[1:] for x in g], [x[1:] for x in p])
    empty = bio.entity_prf(gold.limit(0), pred.limit(0), keys=("k",)).first()
    assert (empty.n_gold, empty.n_pred, empty.tp, empty.f1) == (0, 0, 0, 0.0)


def test_entity_prf_shuffles_packs_not_entities(spark):
    rows = spark.range(8).select(F.lit("k").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(4999))).alias("start"))
    rows = rows.select("k", "start", F.col("start").alias("end"), F.lit("DIS").alias("type"))
    out = bio.entity_prf(rows, rows, keys=("k",))
    plan = out._jdf.queryExecution().executedPlan().toString()
    keyed = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert keyed and not any("start" in line for line in keyed)
    assert (out.first().n_gold, out.first().tp) == (5000, 5000)


def test_spans_of_a_key_over_many_batches():
    rng = random.Random(5)
    g, p = ([(7, s, s + rng.randrange(3) * 40000, rng.choice("xyz")) for s in (rng.randrange(9000) for _ in range(4000))] for _ in range(2))
    packs = []
    for rows, pred in ((g, False), (p, True)):
        cols = [pa.array([r[i] for r in rows]) for i in range(4)]
        whole = pa.RecordBatch.from_arrays(cols, ["k0", "start", "end", "type"])
        packs += span_sets.pack(pred)(whole.slice(i, 900) for i in range(0, 4000, 900))
    table = pa.Table.from_batches(packs).sort_by([("k0", "ascending"), ("block", "ascending")])
    for size in (1, 7, 10**6):
        found = list(span_sets.agreement(1)(table.combine_chunks().to_batches(max_chunksize=size)))
        assert tuple(sum(b.column(i)[0].as_py() for b in found) for i in range(3)) == _want(g, p)


def test_many_types_take_the_sorted_way(monkeypatch):
    tags = [[f"B-t{i % 50}", f"I-t{i % 50}", "O", f"B-t{i}"] for i in range(300)] + [None, []]
    column = pa.array(tags, pa.list_(pa.string()))
    marked = islands.find("strict")(column).to_pylist()
    monkeypatch.setattr(islands, "CELLS", 0)
    assert islands.find("strict")(column).to_pylist() == marked
    assert marked[-1] == {"types": [], "spans": b""}
    assert sorted(marked[3]["types"]) == ["t3"] and sorted(marked[299]["types"]) == ["t299", "t49"]


def test_tags_made_by_an_arrow_function_stay_in_the_worker(spark):
    text = spark.createDataFrame([(1, "aZ b"), (2, None), (3, "")], "doc_id long, text string").repartition(2)
    tag = F.arrow_udf(lambda t: pa.array([None if x is None else ["B-V" if c in "aeiou" else "O" for c in x] for x in t.to_pylist()], pa.list_(pa.string())), "array<string>")
    found = bio.sentence_entities(text.select("doc_id", "text", tag("text").alias("tags")), "text", "tags", keys=("doc_id",))
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [") == 1
    assert [tuple(r) for r in found.collect()] == [(1, 0, 0, "V", "a")]
