"""End-to-end jobs (X1-X5): path in, path out, a small report back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import bio, deid, impute, terms
from ..sources import bio_io, records
from ..sources.vocab import default_vocab


def impute_job(spark: SparkSession, inp: str, out: str, fmt: str = "csv", **kw) -> int:
    """Read records, impute, write.  Returns the count of missing cells, observed in the pass that fits."""
    seen = Observation()
    df = records.read_records(spark, inp, fmt=fmt).observe(seen, impute.missing_cells().alias("n_missing"))
    records.write_records(impute.impute(df, **kw), out, fmt=fmt)
    return int(seen.get["n_missing"])


def convert_job(spark: SparkSession, inp: str, out: str, type_map: dict | None = None,
                multiline: bool = True) -> int:
    """Annotated examples (JSON) -> BIO text.  Returns the example count, observed while writing."""
    seen = Observation()
    ex = bio_io.read_examples(spark, inp, multiline=multiline).observe(seen, F.count(F.lit(1)).alias("n_examples"))
    bio_io.write_bio(bio.convert_examples(ex, type_map=type_map), out)
    return int(seen.get["n_examples"])


def map_terms_job(spark: SparkSession, df: DataFrame, term_col: str = "disease_name_raw",
                  vocab: DataFrame | None = None, **kw) -> DataFrame:
    """Map a column of raw terms to codes (one row per input row)."""
    return terms.map_terms(df, vocab if vocab is not None else default_vocab(spark), term_col, **kw)


def deidentify_job(spark: SparkSession, inp: str, out: str, fmt: str = "csv", **kw) -> dict:
    """Read, de-identify, write; returns the report as a dict."""
    res = deid.deidentify(records.read_records(spark, inp, fmt=fmt), **kw)
    records.write_records(res.data, out, fmt=fmt)
    report = res.report.first().asDict()
    res.release()
    return report


def governance_run(spark: SparkSession, records_df: DataFrame, *, vocab: DataFrame | None = None,
                   tagger=None, key: str = "patient_id", salt: str = "", drop=("clinical_note",)):
    """The documented order over one record table: impute -> tag notes ->
    map terms -> de-identify.  Returns (records, entities, report); the records keep
    the score, status (e.g. manual review) and match type of their mapped term."""
    from ..operators import tagger as tg_op
    df = impute.impute(records_df)
    ents = None
    if tagger is not None and "clinical_note" in df.columns:
        ents = tg_op.tag_notes(tagger, df, key=key, text="clinical_note")
    if "disease_name_raw" in df.columns:
        df = map_terms_job(spark, df, "disease_name_raw", vocab).withColumnRenamed("code", "disease_code")
    res = deid.deidentify(df, key=key, salt=salt, drop=tuple(c for c in drop if c in df.columns))
    return res.data, ents, res.report.select(*res.report.columns, F.lit(True).alias("imputed"))
