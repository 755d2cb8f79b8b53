"""Registered streaming queries: the log is staged as files and replayed as a stream."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.tables import table
from ..streaming.generalise import generalise_stream
from ..streaming.ledger_stream import apply_requests_stream, read_results
from .ledger_queries import ORACLE as LEDGER_ORACLE
from .ledger_queries import event_requests

N_PARTS = 3


def replay(df, src, start, n_parts=N_PARTS, key="seq"):
    """Feed ``df`` to a stream in contiguous ranges of ``key``: each range is written as files by all tasks, then
    ``start(stream)`` runs until it has taken them in."""
    b = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    lo, width = (0, 1) if b.lo is None else (b.lo, (b.hi - b.lo) // n_parts + 1)
    for i in range(n_parts):
        part = df.where((F.col(key) >= lo + i * width) & (F.col(key) < lo + (i + 1) * width))
        part.write.mode("append").parquet(src)
        start(df.sparkSession.readStream.schema(df.schema).parquet(src)).awaitTermination()


def q_ledger_stream(spark, sf_dir):
    base = scratch_path(spark, "ledger-stream")
    src, out, ck = (os.path.join(base, x) for x in ("src", "out", "ck"))
    replay(event_requests(spark, sf_dir), src, lambda stream: apply_requests_stream(stream, out, ck))
    return read_results(spark, out)


def q_stream_generalise(spark, sf_dir):
    base = scratch_path(spark, "gen-stream")
    src, out, ck = (os.path.join(base, x) for x in ("src", "out", "ck"))
    e = table(spark, sf_dir, "events")
    recs = e.select("event_id", F.col("value").alias("age_months"),
                    F.concat(F.col("event_type"), F.lit(", site"), (F.col("user_id") % 5).cast("string"))
                    .alias("location"),
                    F.date_format("ts", "yyyy-MM-dd").alias("diagnosis_date"))
    replay(recs, src, lambda stream: generalise_stream(stream, out, ck), key="event_id")
    return spark.read.parquet(out)


QUERIES = {
    "ledger_stream": q_ledger_stream,
    "stream_generalise": q_stream_generalise,
}

ORACLE = {
    "ledger_stream": LEDGER_ORACLE["ledger_results"],
    "stream_generalise": """
  SELECT event_id, value AS age_months,
         CASE WHEN trim(split_part(event_type || ', site' || CAST(user_id % 5 AS VARCHAR), ',', 1)) = '' THEN '*'
              ELSE trim(split_part(event_type || ', site' || CAST(user_id % 5 AS VARCHAR), ',', 1)) END AS location,
         substr(strftime(ts, '%Y-%m-%d'), 1, 7) AS diagnosis_date,
         '[' || CAST(CAST(floor(value / 12.0) AS BIGINT) * 12 AS VARCHAR) || ','
             || CAST(CAST(floor(value / 12.0) AS BIGINT) * 12 + 12 AS VARCHAR) || ')' AS age_months_gen
  FROM events""",
}
