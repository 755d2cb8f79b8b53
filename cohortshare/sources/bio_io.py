"""Annotated examples (JSON), BIO text files and plain-text corpora."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tags import LABELS
from ..schemas import EXAMPLE
from .spanning import read_json_array


def read_examples(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """A3: one JSON array of {text, entities[]} a file (or JSON Lines with ``multiline=False``).

    Missing ``entities`` becomes an empty list.  One row per example, with
    ``ex_id`` an opaque id taken right after the read.  An array is read by as
    many tasks as its file has splits.
    """
    df = read_json_array(spark, path, EXAMPLE) if multiline else spark.read.schema(EXAMPLE).json(path)
    return df.select(F.monotonically_increasing_id().alias("ex_id"), "text",
                     F.coalesce("entities", F.array().cast(EXAMPLE["entities"].dataType)).alias("entities"))


def _as_array(batches):
    """The lines of a partition as one JSON array."""
    mark = "["
    for b in batches:
        lines = [mark + line if i == 0 else "," + line for i, line in enumerate(b.column(0).to_pylist())]
        if lines:
            mark = ","
            yield pa.RecordBatch.from_pydict({"value": lines})
    yield pa.RecordBatch.from_pydict({"value": ["]" if mark == "," else "[]"]})


def write_examples(df: DataFrame, path: str, array: bool = False) -> None:
    """JSON Lines of {text, entities}, or with ``array`` one JSON array a file."""
    df = df.select("text", "entities")
    if array:
        lines = df.select(F.to_json(F.struct("text", "entities")).alias("value"))
        lines.mapInArrow(_as_array, "value string").write.mode("overwrite").text(path)
    else:
        df.write.mode("overwrite").json(path)


def bio_text(pairs) -> F.Column:
    """One example as BIO text: ``char tag`` lines, then the blank line that ends it."""
    p = pairs if isinstance(pairs, F.Column) else F.col(pairs)
    lines = F.array_join(F.transform(p, lambda x: F.concat(x["ch"], F.lit(" "), x["tag"])), "\n")
    return F.when(F.size(p) > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))


def write_bio(df: DataFrame, path: str, pairs: str = "pairs") -> None:
    """A5: each row's (ch, tag) pairs as lines, a blank line after every example
    (also after an empty one).  Round-trips with :func:`read_bio`."""
    df.select(bio_text(pairs).alias("value")).write.mode("overwrite").option("lineSep", "\n").text(path)


def read_bio(spark: SparkSession, path: str, mode: str = "failfast", line_sep: str = "\n\n",
             labels: list[str] | None = LABELS) -> DataFrame:
    """A4: BIO text -> one row per sentence (file, sent_id, tokens, tags[, bad_lines]).

    The file is read split-parallel with a blank-line record separator; each
    record is cleaned of ``\\r`` and re-split on blank lines that hold only
    white space (three newlines, ``" \\n"``, CRLF leave such leftovers).  Lines
    are stripped; a line must hold exactly two white-space separated fields and
    the tag must be in ``labels`` (None: any tag).  ``mode``: ``failfast`` raises
    on a bad line, ``permissive`` takes it out of the tokens and returns it in
    ``bad_lines``.  ``sent_id`` is the file's full path, the record's number and
    the sentence's place in the record.
    """
    raw = (spark.read.option("lineSep", line_sep).text(path)
           .select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("chunk"),
                   F.regexp_replace("value", "\r", "").alias("value")))
    sents = raw.select("file", "chunk", F.posexplode(F.split("value", r"\n[ \t\f\x0B]*\n")).alias("piece", "s"))
    lines = F.filter(F.transform(F.split("s", "\n"), lambda ln: F.regexp_replace(ln, r"(?U)^\s+|\s+$", "")),
                     lambda ln: ln != "")
    sents = sents.select("file", F.concat_ws(":", "file", "chunk", "piece").alias("sent_id"),
                         F.transform(lines, lambda ln: F.struct(ln.alias("line"),
                                                                F.split(ln, r"(?U)\s+").alias("f"))).alias("ls"))
    sents = sents.where(F.size("ls") > 0)
    ok_label = (lambda f: F.array_contains(F.array(*[F.lit(x) for x in labels]), f[1])) if labels else \
        (lambda f: F.lit(True))
    good = lambda x: (F.size(x["f"]) == 2) & ok_label(x["f"])
    keep = F.filter("ls", good)
    tokens = F.transform(keep, lambda x: x["f"][0])
    if mode == "failfast":
        bad = F.filter("ls", lambda x: ~good(x))
        tokens = F.when(F.size(bad) > 0, F.raise_error(
            F.concat(F.lit("malformed BIO line: "), F.get(bad, 0)["line"]))).otherwise(tokens)
    elif mode != "permissive":
        raise ValueError(f"mode must be failfast or permissive, not {mode!r}")
    out = sents.select("file", "sent_id", tokens.alias("tokens"),
                       F.transform(keep, lambda x: x["f"][1]).alias("tags"),
                       *([F.transform(F.filter("ls", lambda x: ~good(x)), lambda x: x["line"]).alias("bad_lines")]
                         if mode == "permissive" else []))
    if mode != "permissive":
        out = out.where(F.size("tokens") > 0)
    return out


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Plain text, one sentence per row, column ``text``."""
    return spark.read.text(path).withColumnRenamed("value", "text")
