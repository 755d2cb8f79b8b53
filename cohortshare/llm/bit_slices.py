"""Ranked lexical search over bit-sliced Bloom signatures.

**Index.** Documents with like numbers of distinct terms share a block. A block is a bit matrix: a row (slice) for each
place of a Bloom filter, a column for each document. A term's entry sets ``HASHES`` places; a term that occurs at least
2, 4 or 8 times has a further entry for each of these levels. The width of a block's filter follows from its documents'
number of entries, so long documents do not fill it up. Every document is in the index; it knows nothing of the queries.

**Bounds.** The AND of a term's slices marks every document of the block that has the term, and some that don't. A level's
slices bound the term's occurrences, so a document's score is at most the sum, over the query's terms and levels, of the
slice bits weighted with what that level can add in a document of this length. Bounds are integers like the scores.

**Exact part.** The documents with the largest bounds are scored exactly; the k-th best of them is a threshold that the
k-th best of all reaches at least. All documents with a bound at or above the threshold of some query are scored exactly
from their texts. A document left out has a bound, and so a score, below k documents. Results are exact.

Queries go block by block (``QUERY_BYTES`` of text each), so what is broadcast is bounded however many there are.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, id_and_text, id_or_null, ids_of, raw_texts, ship, small_or_shuffled, stored
from .super_kmers import mix

TOP = 20
PROBES = 64                # documents with the largest bounds that set a query's threshold
HASHES = 3
BITS_PER_ENTRY = 12        # at most 22 % of the bits are set, so about 1 % of absent terms look present
LEVELS = (1, 2, 4, 8)      # occurrences from which a term has a further entry
BLOCK_DOCS = 512
BLOCK_BYTES = 1 << 25      # of a block's bit matrix; very long documents make blocks of fewer columns
QUERY_BYTES = 1 << 22
SMALL_KEYS = 300_000       # (doc_id, fp) pairs of 16 bytes that may be broadcast

_U = np.uint64
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(raw: bytes) -> list[bytes]:
    """Terms of a text: runs of ASCII letters and digits and of all non-ASCII characters, A-Z lower-cased."""
    return raw.translate(_TERM_BYTES).split()


# ---------------------------------------------------------------- index

def places(hashes: np.ndarray, level: int, width: int) -> np.ndarray:
    """[term, i]: the i-th place of a term's entry for a level, in a filter of ``width`` places."""
    salts = np.arange(HASHES, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(level * 0x2545F491)
    return (mix(hashes[:, None] ^ salts[None, :]) % _U(width)).astype(np.int64)


class _TermHashes(dict):
    """64-bit hashes of terms; forgotten when there are too many."""

    def __missing__(self, term: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[term] = xxhash.xxh3_64_intdigest(term)
        return h


def width_of(entries: int) -> int:
    """Places of the filter for documents of up to ``entries`` entries, rounded up to a power of two."""
    return BITS_PER_ENTRY << max(entries - 1, 15).bit_length()


def block_size(width: int) -> int:
    return min(BLOCK_DOCS, max(8, BLOCK_BYTES * 8 // width // 8 * 8))


def _block_row(width: int, docs: list) -> tuple:
    bits = np.zeros((width, -(-len(docs) // 8)), np.uint8)
    for i, (_, _, _, found) in enumerate(docs):
        bits[found, i >> 3] |= np.uint8(1 << (i & 7))       # places of one document are distinct
    return [d[0] for d in docs], [d[1] for d in docs], [d[2] for d in docs], width, zstandard.ZstdCompressor(1).compress(bits.tobytes())


BLOCK = "doc_ids array<long>, fps array<long>, sizes array<long>, width long, slices binary"
_BLOCK_TYPES = pa.schema([("doc_ids", pa.list_(pa.int64())), ("fps", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())),
                          ("width", pa.int64()), ("slices", pa.binary())])


def _blocks(batches):
    """(doc_id, text, fp) -> index blocks of the documents that have a term."""
    hash_of, open_ = _TermHashes(), {}

    def out(width):
        docs = open_.pop(width)
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(_block_row(width, docs), _BLOCK_TYPES.types)], schema=_BLOCK_TYPES)
    for b in batches:
        for doc_id, raw, fp in zip(ids_of(b.column(0)), raw_texts(b.column(1)), b.column(2).to_pylist()):
            words = terms_of(raw)
            if not words:
                continue
            counts = Counter(words)
            hashes = np.array([hash_of[t] for t in counts], np.uint64)
            tf = np.fromiter(counts.values(), np.int64, len(counts))
            entries = [hashes[tf >= level] for level in LEVELS]
            width = width_of(sum(map(len, entries)))
            found = np.unique(np.concatenate([places(h, level, width).reshape(-1) for h, level in zip(entries, LEVELS)]))
            open_.setdefault(width, []).append((doc_id, fp, len(words), found))
            if len(open_[width]) >= block_size(width):
                yield out(width)
    for width in list(open_):
        yield out(width)


def _keyed(docs: DataFrame) -> DataFrame:
    return id_and_text(docs).withColumn("fp", F.xxhash64("text"))


def build_index(docs: DataFrame) -> DataFrame:
    """The bit-sliced signatures of all documents with a term, a stored table of blocks."""
    return stored(_keyed(docs).mapInArrow(_blocks, BLOCK), "bit-slices")


# ---------------------------------------------------------------- queries

class Queries:
    """A block of queries: their terms as numbers, and weights once the corpus has been counted."""

    def __init__(self, items: list[tuple]):
        counts = [Counter(terms_of(raw)) for _, raw in items]
        self.ids = [i for i, _ in items]
        self.terms = sorted(set().union(*counts))
        self.number = {t: i for i, t in enumerate(self.terms)}
        self.hashes = np.array([xxhash.xxh3_64_intdigest(t) for t in self.terms], np.uint64)
        self.parts = [(np.array([self.number[t] for t in c], np.int64), np.array(list(c.values()), np.int64)) for c in counts]
        self.n = self.length = 0

    def weigh(self, n: int, length: int, df: dict[int, int]) -> None:
        """Corpus statistics: documents with a term, all their terms, documents by term number."""
        self.n, self.length = n, length
        w = np.zeros(len(self.terms), np.int64)
        for t, d in df.items():
            w[t] = math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1)))
        self.parts = [(t[w[t] > 0], (c * w[t])[w[t] > 0]) for t, c in self.parts]
        # term number -> the queries that have it, and the weight there
        at = np.concatenate([np.full(len(t), q) for q, (t, _) in enumerate(self.parts)] or [np.zeros(0)]).astype(np.int64)
        term = np.concatenate([t for t, _ in self.parts] or [np.zeros(0, np.int64)])
        weight = np.concatenate([x for _, x in self.parts] or [np.zeros(0, np.int64)])
        order = np.argsort(term, kind="stable")
        self.by_term = at[order], weight[order], np.searchsorted(term[order], np.arange(len(self.terms) + 1))

    def damping(self, size):
        """12 m of documents of ``size`` terms."""
        return 12 * (100 - 25 + 25 * size * self.n // self.length)


def gain(tf, damping):
    """What a term of weight 1 with ``tf`` occurrences adds; never less for more occurrences."""
    return 1_000_000_000 * tf // (1000 * tf + damping)


def upper_bounds(q: Queries, sizes: np.ndarray, width: int, slices: bytes) -> np.ndarray:
    """[query, document]: at least the document's score, for the documents of one block."""
    bits = np.frombuffer(zstandard.ZstdDecompressor().decompress(slices), np.uint8).reshape(width, -1)
    damping = q.damping(sizes)
    most = [gain(np.minimum(np.int64(after - 1), sizes), damping) for after in LEVELS[1:]] + [gain(sizes, damping)]
    adds = [most[0]] + [b - a for a, b in zip(most, most[1:])]
    may, total = None, np.zeros((len(q.terms), len(sizes)), np.int64)
    for level, add in zip(LEVELS, adds):
        at = places(q.hashes, level, width)
        hit = np.bitwise_and.reduce([bits[at[:, i]] for i in range(HASHES)])
        may = hit if may is None else may & hit
        total += np.unpackbits(may, axis=1, count=len(sizes), bitorder="little") * add
    return np.array([(weight[:, None] * total[t]).sum(axis=0) for t, weight in q.parts], np.int64).reshape(len(q.parts), len(sizes))


def exact_scores(q: Queries, words: list[bytes]) -> np.ndarray:
    """Scores of a document with these terms for every query."""
    scores = np.zeros(len(q.parts), np.int64)
    at, weight, edge = q.by_term
    damping = q.damping(len(words))
    for term, tf in Counter(words).items():
        if (i := q.number.get(term)) is not None:
            part = slice(edge[i], edge[i + 1])
            scores[at[part]] += weight[part] * gain(tf, damping)      # a query has a term once
    return scores


def _statistics(queries):
    """Text -> per task (term number or -1, documents, terms); -1: all documents with a term."""
    def run(batches):
        q, n, length, df = queries.value, 0, 0, Counter()
        for b in batches:
            for raw in raw_texts(b.column(0)):
                words = terms_of(raw)
                n += bool(words)
                length += len(words)
                df.update(q.number.keys() & set(words))
        rows = [(-1, n, length), *((q.number[t], c, 0) for t, c in df.items())]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["term", "n", "length"])
    return run


def _largest_bounds(queries, probes: int):
    """Blocks -> per task the (query, doc_id, fp, bound) of each query's largest bounds."""
    def run(batches):
        q = queries.value
        best = [[] for _ in q.parts]
        for b in batches:
            for ids, fps, sizes, width, slices in zip(*(c.to_pylist() for c in b.columns)):
                bounds = upper_bounds(q, np.array(sizes, np.int64), width, slices)
                for heap, row in zip(best, bounds):
                    for i in np.argsort(-row, kind="stable")[:probes].tolist():
                        if row[i] > 0 and (len(heap) < probes or row[i] > heap[0][0]):
                            (heapq.heappushpop if len(heap) >= probes else heapq.heappush)(heap, (int(row[i]), ids[i], fps[i]))
        rows = [(k, i, fp, x) for k, heap in enumerate(best) for x, i, fp in heap]
        cols = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["q", "doc_id", "fp", "bound"])
    return run


def _not_excluded(queries, thresholds):
    """Blocks -> (doc_id, fp) of the documents whose bound reaches some query's threshold."""
    def run(batches):
        q, least = queries.value, np.array(thresholds, np.int64)[:, None]
        for b in batches:
            for ids, fps, sizes, width, slices in zip(*(c.to_pylist() for c in b.columns)):
                keep = (upper_bounds(q, np.array(sizes, np.int64), width, slices) >= least).any(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()).filter(pa.array(keep)), pa.array(fps, pa.int64()).filter(pa.array(keep))],
                                                 ["doc_id", "fp"])
    return run


def _scored(queries, thresholds, top: int):
    """(doc_id, text) -> per task (query, doc_id, score) of each query's best documents at or above its threshold."""
    def run(batches):
        q, least = queries.value, np.array(thresholds, np.int64)
        best = [[] for _ in q.parts]
        for b in batches:
            for doc_id, raw in zip(ids_of(b.column(0)), raw_texts(b.column(1))):
                scores = exact_scores(q, terms_of(raw))
                for k in np.flatnonzero(scores >= least).tolist():
                    item = (int(scores[k]), -doc_id)
                    (heapq.heappushpop if len(best[k]) >= top else heapq.heappush)(best[k], item)
        rows = [(k, -i, x) for k, heap in enumerate(best) for x, i in heap]
        cols = list(zip(*rows)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["q", "doc_id", "score"])
    return run


def _texts_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """doc_id, text of the documents named by (doc_id, fp) of ``keys``, a stored table."""
    named = small_or_shuffled(keys, SMALL_KEYS).select(F.col("doc_id").alias("k_id"), F.col("fp").alias("k_fp"))
    rows = _keyed(docs)
    on = (F.coalesce(rows["doc_id"], F.lit(NULL_ID)) == named["k_id"]) & (rows["fp"] == named["k_fp"])
    return rows.join(named, on, "left_semi").select("doc_id", "text")


def _best(rows: DataFrame, by: list, top: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*by))).where(F.col("rank") <= top)


def _rank_block(docs: DataFrame, index: DataFrame, items: list[tuple], top: int, probes: int) -> DataFrame:
    spark, q = docs.sparkSession, Queries(items)
    counted = (id_and_text(docs).select("text").mapInArrow(_statistics(spark.sparkContext.broadcast(q)), "term long, n long, length long")
               .groupBy("term").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).collect())
    every = next((r for r in counted if r["term"] == -1), None)
    if every and every["n"]:
        q.weigh(every["n"], every["length"], {r["term"]: r["n"] for r in counted if r["term"] >= 0})
    else:
        q.parts = []
    queries = spark.sparkContext.broadcast(q)
    score = "q long, doc_id long, score long"
    tried = index.mapInArrow(_largest_bounds(queries, probes), "q long, doc_id long, fp long, bound long")
    tried = stored(_best(tried, [F.desc("bound"), "doc_id", "fp"], probes).select("doc_id", "fp").distinct(), "largest-bounds")
    found = _texts_of(docs, tried).mapInArrow(_scored(queries, [1] * len(q.parts), top), score)
    kth = _best(found, [F.desc("score"), "doc_id"], top).where(F.col("rank") == top).select("q", "score").collect()    # a row per query
    thresholds = [1] * len(q.parts)
    for r in kth:
        thresholds[r["q"]] = r["score"]
    open_ = stored(index.mapInArrow(_not_excluded(queries, thresholds), "doc_id long, fp long").distinct(), "not-excluded")
    ranked = _best(_texts_of(docs, open_).mapInArrow(_scored(queries, thresholds, top), score), [F.desc("score"), "doc_id"], top)
    names = spark.createDataFrame([(k, i) for k, i in enumerate(q.ids)], "q long, item_id long")
    return stored(ranked.join(F.broadcast(names), "q").select("item_id", F.col("rank").cast("int").alias("rank"),
                                                              id_or_null(F.col("doc_id")).alias("doc_id"), "score"), "ranked")


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP, probes: int = PROBES, index: DataFrame | None = None) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``top`` best documents of every row of ``items`` (item_id, text).

    Equal scores by ascending doc_id, null last; documents without any of the item's terms are not listed. A null or
    empty text has no terms. Every row of ``items`` is ranked by itself, also where ids repeat; repeated documents each
    take a rank. No documents or no items: no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    index = build_index(docs) if index is None else index
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-(size + 1) // QUERY_BYTES)
    out = None
    for i in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i) if blocks > 1 else items
        ranked = _rank_block(docs, index, [(r["item_id"], r["text"].encode()) for r in part.collect()], top, probes)
        out = ranked if out is None else out.unionByName(ranked)
    return out
