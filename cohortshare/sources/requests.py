"""The ledger's request log as a table or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import REQUEST


def read_requests(spark: SparkSession, path: str, fmt: str = "parquet", stream: bool = False,
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """Request rows (seq, caller, op, id, data_hash, description, grantee, ts)."""
    r = spark.readStream if stream else spark.read
    r = r.schema(REQUEST).format(fmt)
    if stream and max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def write_requests(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.select(*[f.name for f in REQUEST.fields]).write.mode("append").format(fmt).save(path)
