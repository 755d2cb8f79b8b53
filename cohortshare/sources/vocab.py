"""The standard vocabulary (ordered name -> code)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..schemas import VOCAB

# The minimal vocabulary shipped with the method, in its order.
# Two names may share one code.
STANDARD_TERMS = [
    ("杜氏肌营养不良", "ORPHA:98896"),
    ("假肥大型肌营养不良", "ORPHA:98896"),
    ("庞贝病", "ORPHA:365"),
    ("戈谢病", "ORPHA:355"),
    ("苯丙酮尿症", "ORPHA:716"),
    ("法布雷病", "ORPHA:324"),
]


def default_vocab(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, c) for i, (n, c) in enumerate(STANDARD_TERMS)], VOCAB)


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header ``ord,std_name,code``; ``ord`` fixes the tie order."""
    df = spark.read.schema(VOCAB).option("header", True).option("escape", '"').csv(path)
    return clean_vocab(df)


def clean_vocab(df: DataFrame) -> DataFrame:
    """Reject blank names (they would score 1 against a blank term without sharing
    a character) and keep the first entry of a repeated name, as a dict would."""
    df = df.where(F.col("std_name").isNotNull() & ~is_blank("std_name"))
    return (df.groupBy("std_name")
            .agg(F.min_by(F.struct("ord", "code"), F.col("ord")).alias("e"))
            .select(F.col("e.ord").alias("ord"), "std_name", F.col("e.code").alias("code")))


def write_vocab(df: DataFrame, path: str) -> None:
    df.select("ord", "std_name", "code").write.mode("overwrite").option("header", True).csv(path)
