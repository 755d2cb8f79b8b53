"""The stateless generalisation steps on a stream (k-anonymity and noise
need the whole table and stay batch-only)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import deid


def generalise_stream(stream: DataFrame, out_dir: str, checkpoint: str, available_now: bool = True, **kw):
    """Append generalised records to Parquet files under ``out_dir``."""
    g = deid.apply_generalisation(stream, **kw)
    w = g.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w
    return w.outputMode("append").start()
