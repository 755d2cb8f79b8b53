"""Shared helpers of the corpus operators: reading, byte views of texts, stored tables.

Conventions of every operator here
----------------------------------
* A *word* is a maximal run of characters outside ``[\\x20\\x09-\\x0D]``; on UTF-8 bytes that is ``bytes.split()``.
* Each row is one document. A null text counts as the empty text. Operators read only the columns they
  name, so further columns (also ones named like a result column) never clash.
* A row is recognised again by ``(doc_id, text fingerprint)``; fully repeated rows share the key and get equal results.
* A null ``doc_id`` sorts after every number (``NULL_ID`` inside, null again in results).
"""

from __future__ import annotations

import ctypes
import shutil
import tempfile
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

NULL_ID = (1 << 63) - 1
LOWER_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER_TO = LOWER_FROM.lower()


@lru_cache(maxsize=4)
def _shipped(application_id: str) -> str:
    root = Path(__file__).resolve().parents[2]
    return shutil.make_archive(str(Path(tempfile.mkdtemp()) / "cohortshare"), "zip", root, "cohortshare")


def ship(spark: SparkSession) -> None:
    """Send the package along with the job, once per application, as ``--py-files`` does."""
    misses = _shipped.cache_info().misses
    archive = _shipped(spark.sparkContext.applicationId)
    if _shipped.cache_info().misses > misses:
        spark.sparkContext.addPyFile(archive)


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote, once what was made of them is stored itself."""
    for df in tables:
        if path := df.__dict__.get("_stored_at"):
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def small_or_shuffled(df: DataFrame, max_rows: int, entries: Column | None = None) -> DataFrame:
    """Mark a stored table for broadcasting when it has at most ``max_rows`` rows; otherwise joins shuffle.

    Where rows hold arrays, ``entries`` is their number in a row, and rows and entries count together.
    """
    if entries is not None:
        size = df.agg(F.coalesce(F.sum(entries + 1), F.lit(0)).alias("size")).first()["size"]
    else:
        size = df.limit(max_rows + 1).count()
    return F.broadcast(df) if size <= max_rows else df


def tidy(run):
    """``run``, a function over batches, that gives freed memory back to the system when its task ends.

    Python workers outlive their tasks; what allocators keep of a stage's batches would add up from stage to stage.
    """
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)       # the GNU C library has it
            if trim:
                trim(0)
    return wrapped


def raw_texts(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b or b"" for b in column.cast(kind).to_pylist()]


def ids_of(column) -> list[int]:
    """doc_id values with null as ``NULL_ID``."""
    return [NULL_ID if v is None else v for v in column.to_pylist()]


def signed64(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def fingerprint(raw: bytes) -> int:
    """64-bit fingerprint of a text, as a signed long."""
    return signed64(xxhash.xxh3_64_intdigest(raw))


def id_or_null(c: Column) -> Column:
    return F.when(c == F.lit(NULL_ID), F.lit(None)).otherwise(c)


def id_and_text(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fresh_name(columns, base: str) -> str:
    """A column name that no input column has (whatever its case)."""
    taken, name = {c.lower() for c in columns}, base
    while name.lower() in taken:
        name += "_"
    return name
