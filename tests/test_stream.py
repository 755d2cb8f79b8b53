import os

import pytest
from pyspark.sql import functions as F

from cohortshare.operators import ledger as lg
from cohortshare.plans.ledger_queries import event_requests
from cohortshare.plans.stream_queries import replay
from cohortshare.streaming.ledger_stream import apply_requests_stream, read_results, read_state

from conftest import SF_SMALL


def _start(out, ck, **kw):
    return lambda stream: apply_requests_stream(stream, out, ck, **kw)


def _parts(spark, tmp_path, parts):
    """Run the stream once for each part of the log."""
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    for p in parts:
        p.write.mode("append").parquet(src)
        _start(out, ck)(spark.readStream.schema(p.schema).parquet(src)).awaitTermination()
    return out


def test_stream_in_several_batches_equals_batch(spark, tmp_path):
    reqs = event_requests(spark, SF_SMALL)
    batch = lg.apply_requests(reqs)
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    replay(reqs.repartition(5), src, _start(out, ck), n_parts=4)
    assert len(os.listdir(os.path.join(out, "results"))) >= 4
    got = sorted(tuple(r) for r in read_results(spark, out).select("seq", "status", "message").collect())
    exp = sorted(tuple(r) for r in batch.results.select("seq", "status", "message").collect())
    assert got == exp
    st = read_state(spark, out).where(F.col("owner").isNotNull()).select("id", "owner", "access_list").collect()
    assert sorted(map(tuple, st)) == sorted(map(tuple, batch.assets.select("id", "owner", "access_list").collect()))


def test_out_of_order_parts_give_late(spark, tmp_path):
    reqs = event_requests(spark, SF_SMALL)
    half = reqs.agg(F.max("seq")).first()[0] // 2
    out = _parts(spark, tmp_path, [reqs.where(F.col("seq") > half), reqs.where(F.col("seq") <= half)])
    res = read_results(spark, out)
    assert res.count() == reqs.count()
    assert res.where(F.col("status") == "late").count() > 0


def test_epoch_appends_only_its_assets(spark, tmp_path):
    reqs = event_requests(spark, SF_SMALL)
    one = reqs.agg(F.min("id")).first()[0]
    out = _parts(spark, tmp_path, [reqs.where(F.col("id") != one), reqs.where(F.col("id") == one)])
    epochs = sorted((e for e in os.listdir(os.path.join(out, "state")) if e.startswith("epoch=")), key=lambda e: int(e.split("=")[1]))
    last = spark.read.parquet(os.path.join(out, "state", epochs[-1]))
    assert [r.id for r in last.collect()] == [one]
    assert {r.id for r in read_state(spark, out).collect()} == {r.id for r in reqs.select("id").distinct().collect()}


def test_another_bucket_count_is_refused(spark, tmp_path):
    reqs = event_requests(spark, SF_SMALL)
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    replay(reqs, src, _start(out, ck, n_buckets=48), n_parts=1)
    with pytest.raises(ValueError, match="48 buckets, not 64"):
        _start(out, ck)(spark.readStream.schema(reqs.schema).parquet(src))
