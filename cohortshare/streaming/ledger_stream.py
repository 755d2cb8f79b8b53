"""The ledger over an unbounded request log (Structured Streaming).

Each micro-batch is applied with the batch fold of :mod:`operators.ledger`,
seeded by what earlier batches left. The state is an append-only Parquet table
of versions, ``state/epoch=E/bucket=B``: an epoch appends one row for every
asset its requests named, and an asset's state is its row of the latest epoch.

* every step is the skew-safe batch plan (aggregates + equi-joins), never one
  Python group per asset;
* an epoch reads only the buckets of its assets' ids (partition pruning) and
  writes only its own assets, so its cost follows the batch; it reads its part of the log twice, first the ids,
  and the state and the log joined with it once (kept until the epoch is written);
* a retried epoch rewrites its own folder and reads only those before it;
  lineage is cut at every epoch by the written tables;
* the number of buckets is stored beside the state; a stream that is
  restarted with another number is refused.

A request whose ``seq`` is at or below the last one applied for its asset is
answered ``late`` and changes nothing.  Feed the log in ``seq`` order per asset
(e.g. a source keyed by asset id) to get the batch results exactly.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger as lg
from ..schemas import LEDGER_STATE

N_BUCKETS = 64
_STORED = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in LEDGER_STATE.fields) + ", epoch long, bucket int"


def bucket_of(col: str = "id", n: int = N_BUCKETS):
    return F.pmod(F.xxhash64(F.col(col)), F.lit(n)).cast("int")


def _open_state(spark: SparkSession, out_dir: str, n_buckets: int) -> None:
    """Create the state with its bucket count, or check the count of the one that is there."""
    meta = os.path.join(out_dir, "state_buckets")
    try:
        stored = spark.read.schema("n_buckets int").parquet(meta).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = None
    if stored is None:
        spark.createDataFrame([], LEDGER_STATE).write.mode("overwrite").parquet(os.path.join(out_dir, "state", "epoch=-1", "bucket=0"))
        spark.createDataFrame([(n_buckets,)], "n_buckets int").coalesce(1).write.mode("overwrite").parquet(meta)
    elif stored.n_buckets != n_buckets:
        raise ValueError(f"the state in {out_dir} has {stored.n_buckets} buckets, not {n_buckets}")


def _versions(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.schema(_STORED).parquet(os.path.join(out_dir, "state"))


def _latest(versions: DataFrame) -> DataFrame:
    """The row of the latest epoch of every id (a partial maximum per id)."""
    row = F.struct(*[f.name for f in LEDGER_STATE.fields])
    return versions.groupBy("id").agg(F.max_by(row, "epoch").alias("v")).select("v.*")


def apply_requests_stream(requests: DataFrame, out_dir: str, checkpoint: str, *, n_buckets: int = N_BUCKETS,
                          available_now: bool = True, processing_time: str | None = None):
    """Start the stream; results go to ``out_dir/results`` (one folder per epoch)
    and the versions of the ledger state to ``out_dir/state``.  Returns the StreamingQuery."""
    spark = requests.sparkSession
    _open_state(spark, out_dir, n_buckets)

    def step(batch: DataFrame, epoch_id: int) -> None:
        ids = batch.select("id").distinct().persist()
        touched = [r.b for r in ids.select(bucket_of("id", n_buckets).alias("b")).distinct().collect()]   # <= n_buckets
        before = _versions(spark, out_dir).where((F.col("epoch") < epoch_id) & F.col("bucket").isin(touched))
        prev = _latest(before.join(ids, "id", "left_semi"))
        res = lg.apply_requests(batch, state=prev)
        res.results.write.mode("overwrite").parquet(os.path.join(out_dir, "results", f"epoch={epoch_id}"))
        (res.state.withColumn("bucket", bucket_of("id", n_buckets)).repartition("bucket")
         .write.mode("overwrite").partitionBy("bucket").parquet(os.path.join(out_dir, "state", f"epoch={epoch_id}")))
        res.release()
        ids.unpersist()

    w = requests.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "10 seconds")
    return w.start()


def read_results(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.parquet(os.path.join(out_dir, "results")).drop("epoch")


def read_state(spark: SparkSession, out_dir: str) -> DataFrame:
    """The current ledger state: the latest version of every asset id."""
    return _latest(_versions(spark, out_dir))
