"""Corpus pipeline: language ID, exact dedup, near dedup, removal of personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet to the shared folder and read again
as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortshare.llm import disclosure, grouped_packing, multi_order_join, patricia, string_kernel
from cohortshare.llm.common import discard, read_documents, ship, stored

MIN_LANGUAGE_SCORE = 0.25    # below it a text is as strange as languages left out of the fit (string_kernel.STRANGER)
SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or like none of the learnt languages, go."""
    return string_kernel.drop_unidentified(docs, MIN_LANGUAGE_SCORE)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the one with the largest doc_id stays."""
    return patricia.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by word shingles the one with the smallest doc_id stays."""
    return multi_order_join.keep_one_of_each(docs, SHINGLE_WORDS, SIMILARITY_PERCENT)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and terms that reveal it, are masked in the text."""
    return disclosure.sanitise(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per token piece, with its training sequence."""
    return grouped_packing.best_fit_pack(docs, forget=True)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("personal_data", personal_data), ("packing", packing)]

#: The first stage is a trained model, which SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = read_documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
