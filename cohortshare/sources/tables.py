"""The driver's parquet tables (one file per table under an ``sf`` folder)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


# Tables whose rows carry long texts: per-row array work dominates, so a small
# input (one row group per file here) is spread over the cores first.
TEXT_TABLES = {"documents", "conversations", "pages"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    if name in TEXT_TABLES:
        from ..session import spread
        df = spread(df)
    return df
