"""Quality rules by cross-document line frequency.

Each ``\\n``-split line is normalised (A-Z lower-cased, white space collapsed) and hashed. Per host (``source``) the
number of *distinct documents* that hold the line is counted; fully equal texts count once, so that copies of a page
don't make its own lines boilerplate (removing copies is another operator's work). Lines above the limit are removed,
and a document that keeps too few of its words is rejected as depleted.

Lines are distinct per document before the shuffle, and counting runs as partial sums over (host, line, text), so
a line or host that a third of the corpus holds is spread over all partitions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fingerprint, fresh_name, raw_texts, ship, signed64, small_or_shuffled, stored

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MAX_DOCS_PER_HOST = 20        # a line in more distinct documents of one host is boilerplate
MIN_WORDS_LEFT = 10           # a document left with fewer words ...
MIN_SHARE_LEFT = 0.3          # ... or with less than this share of its words is depleted
BROADCAST_LINES = 20_000      # boilerplate lines (16 bytes each) up to which the lookup table is broadcast

_PROFILE = ("doc_id long, host long, fp long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
            "n_repeat_words long, lines array<struct<h:long,w:long>>")


def line_key(line: bytes) -> int:
    return signed64(xxhash.xxh3_64_intdigest(b" ".join(line.lower().split())))


def repeated_words(words: list[bytes], k: int = WINDOW) -> int:
    """Words inside k-word windows that occur at least twice in the text, the first occurrence included."""
    windows = list(zip(*(words[i:] for i in range(k))))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    mark = np.zeros(len(words) + 1, np.int32)
    at = np.flatnonzero(np.fromiter((seen[w] > 1 for w in windows), bool, len(windows)))
    np.add.at(mark, at, 1)
    np.add.at(mark, at + k, -1)
    return int(np.count_nonzero(np.cumsum(mark[:-1])))


def profile(raw: bytes) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, [(line key, words of that line in the text)])."""
    words = raw.split()
    joined = np.frombuffer(b"".join(words), np.uint8)
    chars = int(np.count_nonzero((joined & 0xC0) != 0x80))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen, dup, lines = set(), 0, {}
    for line in raw.split(b"\n"):
        n = len(line.split())
        if not n:
            continue
        dup += line in seen
        seen.add(line)
        h = line_key(line)
        lines[h] = lines.get(h, 0) + n
    return len(words), chars, symbols, dup, repeated_words(words), list(lines.items())


def _profiles(batches):
    for b in batches:
        raws = raw_texts(b.column(2))
        cols = list(zip(*map(profile, raws))) or [()] * 6
        counts, lines = cols[:5], cols[5]
        flat = [x for doc in lines for x in doc]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in lines])]).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.int64()),
                                            pa.array([x[1] for x in flat], pa.int64())], ["h", "w"])
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(map(fingerprint, raws), pa.int64()),
             *(pa.array(c, pa.int64()) for c in counts), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)],
            ["doc_id", "host", "fp", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"])


def profiles(docs: DataFrame) -> DataFrame:
    """One row per document with its base counts and its distinct normalised lines (stored once, used twice)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("source")).alias("host"),
                       F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(_profiles, _PROFILE), "line-profiles")


def boilerplate_lines(lines: DataFrame, max_docs: int = MAX_DOCS_PER_HOST) -> DataFrame:
    """(host, h) of the lines that more than ``max_docs`` distinct texts of one host hold."""
    return (lines.select("host", "h", "fp").distinct().groupBy("host", "h").agg(F.count(F.lit(1)).alias("n_docs"))
            .where(F.col("n_docs") > max_docs).select("host", "h"))


def judge_documents(docs: DataFrame, max_docs: int = MAX_DOCS_PER_HOST, min_words: int = MIN_WORDS_LEFT,
                    min_share: float = MIN_SHARE_LEFT) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    n_line_words_removed.

    Null source: a host of its own. Null text: no words, base_failed. No rows: no rows. Rows equal in doc_id,
    source and text get equal results.
    """
    prof = profiles(docs)
    key = ["doc_id", "host", "fp"]
    lines = prof.select(*key, F.explode("lines").alias("line")).select(*key, "line.h", "line.w")
    common = small_or_shuffled(stored(boilerplate_lines(lines, max_docs), "boilerplate-lines"), BROADCAST_LINES)
    removed = (lines.join(common, ["host", "h"], "left_semi")
               .groupBy(*key).agg(F.collect_set(F.struct("h", "w")).alias("hit"))
               .select(F.col("doc_id").alias("r_id"), F.col("host").alias("r_host"), F.col("fp").alias("r_fp"),
                       F.aggregate("hit", F.lit(0).cast("long"), lambda a, x: a + x["w"]).alias("removed")))
    on = (prof["doc_id"].eqNullSafe(removed["r_id"]) & (prof["host"] == removed["r_host"])
          & (prof["fp"] == removed["r_fp"]))
    gone = F.coalesce(F.col("removed"), F.lit(0).cast("long"))
    left = F.col("n_words") - gone
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    depleted = (gone > 0) & ((left < min_words) | (left < min_share * F.col("n_words")))
    return (prof.drop("lines").join(removed, on, "left")
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    failed.alias("base_failed"), (~failed & ~depleted).alias("kept"),
                    gone.alias("n_line_words_removed")))


def _clean(position: int):
    def run(batches):
        for b in batches:
            texts = b.column(position).to_pylist()
            drop = b.column(b.num_columns - 1).to_pylist()
            out = []
            for t, keys in zip(texts, drop):
                if t is not None and keys:
                    keys = set(keys)
                    t = "\n".join(x for x in t.split("\n")
                                  if not x.encode().split() or line_key(x.encode()) not in keys)
                out.append(t)
            cols = list(b.columns)
            cols[position] = pa.array(out, b.column(position).type)
            yield pa.RecordBatch.from_arrays(cols[:-1], b.schema.names[:-1])
    return run


def remove_boilerplate(docs: DataFrame, max_docs: int = MAX_DOCS_PER_HOST) -> DataFrame:
    """``docs`` with the boilerplate lines cut out of ``text``; every other column and row as it was."""
    prof = profiles(docs)
    lines = prof.select("host", "fp", F.explode("lines").alias("line")).select("host", "fp", "line.h")
    hits = (lines.join(boilerplate_lines(lines, max_docs), ["host", "h"], "left_semi")
            .groupBy("host", "fp").agg(F.collect_set("h").alias("cs_drop")))
    fp = F.udf(lambda t: fingerprint((t or "").encode()), "long", useArrow=True)
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("source").alias("host"), fp("text").alias("fp"))
    flat = rows.join(hits, ["host", "fp"], "left").select("row.*", F.col("cs_drop").alias(fresh_name(docs.columns, "cs_drop")))
    return flat.mapInArrow(_clean(docs.columns.index("text")), docs.schema)
