"""A1/A2: clinical record tables (headered CSV or Parquet)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import RECORD
from .spanning import read_csv

# Texts read as missing (the CSV reader defaults the reference relies on).
NA_VALUES = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null"]

NUMERIC = {f.name for f in RECORD.fields if f.dataType.typeName() == "double"}


def read_records(spark: SparkSession, path: str, numeric=None, fmt: str = "csv", bad: str = "fail",
                 multiline: bool = True) -> DataFrame:
    """Read records; every column is text first, missing tokens become NULL, then
    the numeric columns are cast (NaN -> NULL).

    A text that is neither missing nor a number (``36 months``) must not be imputed
    as if it were missing: ``bad="fail"`` raises on it, ``bad="report"`` makes it
    NULL and lists it in a column ``bad_cells`` (``column=text``).

    ``multiline`` allows quoted newlines in notes: many tasks read a file, after a scan
    for the quotes open at each split's start.  Files without quoted newlines
    (``multiline=False``) need no such scan.
    """
    if bad not in ("fail", "report"):
        raise ValueError(f"bad must be fail or report, not {bad!r}")
    numeric = NUMERIC if numeric is None else set(numeric)
    if fmt == "parquet":
        df = spark.read.parquet(path)
        return df.withColumns({c: F.when(F.isnan(F.col(c)), F.lit(None)).otherwise(F.col(c))
                               for c in df.columns if c in numeric})
    df = read_csv(spark, path) if multiline else spark.read.options(header=True, escape='"', inferSchema=False).csv(path)
    refs = {c: F.col(f"`{c}`") for c in df.columns}            # headers may hold dots or spaces
    df = df.withColumns({c: F.when(ref.isin(NA_VALUES), F.lit(None).cast("string")).otherwise(ref) for c, ref in refs.items()})
    cols, unread = {}, []
    for c, v in refs.items():
        if c in numeric:
            d = v.try_cast("double")
            wrong = v.isNotNull() & d.isNull()
            told = F.concat(F.lit(f"{c}="), v)
            unread.append(F.when(wrong, told))
            v = F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)
            if bad == "fail":
                v = F.when(wrong, F.raise_error(F.concat(F.lit("not a number: "), told)).cast("double")).otherwise(v)
            cols[c] = v
    if bad == "report":
        cols["bad_cells"] = F.array_compact(F.array(*unread)) if unread else F.array().cast("array<string>")
    return df.withColumns(cols)


def write_records(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write with a header and no index column (CSV) or as Parquet."""
    if fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
        return
    (df.write.mode("overwrite").option("header", True).option("escape", '"')
     .option("quoteAll", False).csv(path))
