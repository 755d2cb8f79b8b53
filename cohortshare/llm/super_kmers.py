"""Super-k-mers: runs of consecutive k-token windows that share a minimiser.

The minimiser of a window is its m-token substring with the smallest hash (the leftmost one of equals). Equal
windows have equal minimisers, so whatever compares windows can work bucket by bucket, a bucket being the
hash of the minimiser. Consecutive windows with the same minimiser travel as one packed string.

A run has at most k - m + 1 windows and no window twice, and a minimiser that occurs once in the corpus cannot
belong to a repeated window. A bitmap of fixed size (``repeats``) marks the minimisers that may occur twice; the
others stay at home. A wrong mark costs time only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, raw_texts, small_or_shuffled

_POS_BITS = 26
_U = np.uint64
_P = 0x9E3779B97F4A7C15

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@lru_cache(maxsize=1)
def _powers() -> np.ndarray:
    p = np.full(1 << 16, _P, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(29))
    x = x * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where words start and end."""
    ink = np.zeros(len(raw) + 2, np.int8)
    ink[1:-1] = ~_SPACE[np.frombuffer(raw, np.uint8)]
    step = np.diff(ink)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    flat = np.concatenate([[0], np.cumsum(lens)[:-1]])
    inside = np.arange(int(lens.sum())) - np.repeat(flat, lens)
    b = np.frombuffer(raw, np.uint8)
    data = b[~_SPACE[b]].astype(np.uint64) + _U(1)
    return mix(np.add.reduceat(data * _powers()[inside & 0xFFFF], flat))


def byte_hashes(raw: bytes) -> np.ndarray:
    return mix(np.frombuffer(raw, np.uint8).astype(np.uint64) + _U(1))


def token_runs(hashes: np.ndarray, m: int) -> np.ndarray:
    """Hashes of m consecutive tokens along the last axis, put together from runs of 1, 2, 4, ... tokens."""
    out, have, part, span = None, 0, hashes, 1
    while True:
        if m & span:                               # append a run of this length
            if out is None:
                out = part
            else:
                n = part.shape[-1] - have
                out = out[..., :n] * _U(pow(_P, span, 1 << 64)) + part[..., have:]
            have += span
        if have == m:
            return out
        part = part[..., :-span] * _U(pow(_P, span, 1 << 64)) + part[..., span:]
        span *= 2


def first_minimisers(windows: np.ndarray, m: int) -> np.ndarray:
    """Minimiser of each row of a matrix of window token hashes, as ``Scheme.runs`` names it."""
    return (mix(token_runs(windows, m)) >> _U(_POS_BITS)).min(axis=-1)


@dataclass(frozen=True)
class Scheme:
    """Windows of ``k`` tokens with minimisers of ``m`` tokens."""
    k: int
    m: int
    words: bool              # tokens are words, else bytes
    filter_bits: int         # log2 of the places of the repeat filter (see ``repeats``)

    def tokens(self, raw: bytes):
        """(token hashes, byte offset where each token starts, where it ends)."""
        if self.words:
            starts, ends = word_bounds(raw)
            return word_hashes(raw, starts, ends), starts, ends
        return byte_hashes(raw), None, None

    def runs(self, hashes: np.ndarray):
        """(minimiser, first window, number of windows) of every run of windows that share a minimiser."""
        n = len(hashes) - self.k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = token_runs(hashes, self.m)
        place = np.arange(len(h), dtype=np.uint64) & _U((1 << _POS_BITS) - 1)
        cur = (mix(h) >> _U(_POS_BITS) << _U(_POS_BITS)) | place
        w, span = self.k - self.m + 1, 1
        while span * 2 <= w:                       # minimum of w consecutive entries
            cur = np.minimum(cur[:-span], cur[span:])
            span *= 2
        low = np.minimum(cur[:n], cur[w - span:w - span + n])
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        return low[first] >> _U(_POS_BITS), first, np.diff(np.append(first, n))


def spread_hash(minimisers: np.ndarray) -> np.ndarray:
    """Even 64-bit hash of minimisers (minima themselves crowd at small values)."""
    return mix(minimisers * _U(0xD6E8FEB86659FD93) + _U(0x2545F4914F6CDD1D))


def pack(strings: list[bytes], numbers: list[tuple]) -> bytes:
    """Byte strings with a tuple of integers each, as one compressed string."""
    nums = np.array(numbers, "<i8")
    head = np.array(nums.shape, "<i8").tobytes() + np.array([len(s) for s in strings], "<i8").tobytes()
    return zstandard.ZstdCompressor(1).compress(head + nums.tobytes() + b"".join(strings))


def unpack(blob: bytes) -> tuple[list[bytes], list[tuple]]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n, width = np.frombuffer(data, "<i8", 2).tolist()
    lens = np.frombuffer(data, "<i8", n, 16)
    nums = np.frombuffer(data, "<i8", n * width, 16 + 8 * n).reshape(n, width)
    at, out = 16 + 8 * n * (1 + width), []
    for x in lens.tolist():
        out.append(data[at:at + x])
        at += x
    return out, list(map(tuple, nums.tolist()))


def minimiser_hashes(scheme: Scheme):
    """Function text -> even hashes of its runs' minimisers."""
    def of(raw: bytes) -> np.ndarray:
        return spread_hash(scheme.runs(scheme.tokens(raw)[0])[0])
    return of


# ---------------------------------------------------------------- strings of a document

def candidate_strings(scheme: Scheme, repeats: RepeatFilter, raw: bytes):
    """(minimisers, first windows, packed strings) of the runs whose minimiser may occur elsewhere."""
    hashes, starts, ends = scheme.tokens(raw)
    minimisers, first, count = scheme.runs(hashes)
    may = repeats.may_repeat(spread_hash(minimisers))
    minimisers, first, count = minimisers[may], first[may], count[may]
    last = first + count + scheme.k - 2            # last token of the run's last window
    if scheme.words:
        strings = [b" ".join(raw[a:z].split()) for a, z in zip(starts[first].tolist(), ends[last].tolist())]
    else:
        strings = [raw[a:z + 1] for a, z in zip(first.tolist(), last.tolist())]
    return minimisers, first, strings


def bucketed(scheme: Scheme, repeats, n_buckets: int, number_of, combine):
    """Batches of (doc_id, text) -> rows (bucket, packed strings with numbers), a string once per batch.

    ``number_of(doc_id)`` is a string's tuple of numbers, ``combine(a, b)`` merges those of equal strings.
    """
    def run(batches):
        for b in batches:
            best: dict[bytes, tuple] = {}
            home: dict[bytes, int] = {}
            for doc_id, raw in zip(b.column(0).to_pylist(), raw_texts(b.column(1))):
                mins, _, strings = candidate_strings(scheme, repeats.value, raw)
                n = number_of(doc_id)
                for k, s in zip((spread_hash(mins) % _U(n_buckets)).tolist(), strings):
                    if s in best:
                        best[s] = combine(best[s], n)
                    else:
                        best[s], home[s] = n, k
            groups: dict[int, list[bytes]] = {}
            for s, k in home.items():
                groups.setdefault(k, []).append(s)
            blobs = [pack(g, [best[s] for s in g]) for g in groups.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(groups), pa.int32()), pa.array(blobs, pa.binary())],
                                             ["bucket", "strings"])
    return run


def per_bucket(solve, combine):
    """Batches ordered by bucket -> record batches ``solve({string: numbers})`` of each bucket's distinct strings."""
    def run(batches):
        at, best = None, {}
        for b in batches:
            for bucket, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if bucket != at:
                    if best:
                        yield from solve(best)
                    at, best = bucket, {}
                for s, n in zip(*unpack(blob)):
                    best[s] = combine(best[s], n) if s in best else n
        if best:
            yield from solve(best)
    return run


def string_name(s: bytes) -> bytes:
    """128-bit name of a string."""
    return xxhash.xxh3_128_digest(s)


def string_rows(scheme: Scheme, repeats):
    """Batches of (doc_id, text, fp) -> rows (doc_id, fp, first window, name of the string) of the candidate runs."""
    def run(batches):
        for b in batches:
            sizes, firsts, names = [], [np.zeros(0, np.int64)], []
            for raw in raw_texts(b.column(1)):
                _, first, strings = candidate_strings(scheme, repeats.value, raw)
                sizes.append(len(strings))
                firsts.append(first)
                names += map(string_name, strings)
            row = pa.array(np.repeat(np.arange(b.num_rows), sizes), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(row), b.column(2).take(row), pa.array(np.concatenate(firsts)), pa.array(names, pa.binary())],
                ["doc_id", "fp", "first", "string"])
    return run


def ids_repeat(docs: DataFrame) -> bool:
    """Whether any doc_id has several rows, so that it takes a text's fingerprint to tell them apart."""
    return not id_and_text(docs).groupBy("doc_id").count().where("count > 1").isEmpty()


def keyed_texts(docs: DataFrame, by_text: bool = True) -> DataFrame:
    """doc_id, text, fp; without ``by_text`` (no id repeats) fp is 0, which costs nothing where rows are packed."""
    return id_and_text(docs).withColumn("fp", F.xxhash64("text") if by_text else F.lit(0).cast("long"))


def in_buckets(docs: DataFrame, scheme: Scheme, repeats, number_of, combine, buckets_per_partition: int = 4) -> DataFrame:
    """Candidate strings of all documents, rows (bucket, strings) with a bucket's rows together in one partition."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * buckets_per_partition
    return (id_and_text(docs).mapInArrow(bucketed(scheme, repeats, n, number_of, combine), "bucket int, strings binary")
            .repartition("bucket").sortWithinPartitions("bucket"))


# ---------------------------------------------------------------- covered tokens

def set_bits(first: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """All first + i where bit i of the mask is set, sorted and distinct."""
    bits = np.unpackbits(mask.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, bit = np.nonzero(bits)
    return np.unique(first[row] + bit)


def _merge_marks(k: int):
    """(doc_id, fp, [(first window, mask)]) -> (doc_id, fp, from, to): maximal covered token ranges."""
    def run(batches):
        for b in batches:
            marks = b.column(2)
            first, mask = (np.asarray(x) for x in marks.flatten().flatten())
            cut, froms, tos = np.cumsum([0, *marks.value_lengths().to_pylist()]), [], []
            for a, z in zip(cut[:-1], cut[1:]):
                at = set_bits(first[a:z], mask[a:z])
                new = np.flatnonzero(np.concatenate([[True], at[1:] > at[:-1] + k]))
                froms.append(at[new].tolist())
                tos.append((at[np.append(new[1:], len(at)) - 1] + k).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(froms, pa.list_(pa.int64())),
                                              pa.array(tos, pa.list_(pa.int64()))], ["doc_id", "fp", "cut_from", "cut_to"])
    return run


def covered_ranges(marks: DataFrame, k: int) -> DataFrame:
    """Rows (doc_id, fp, first, mask: bit i set = window first + i) -> one row per document with its covered ranges."""
    grouped = marks.groupBy("doc_id", "fp").agg(F.collect_set(F.struct("first", "mask")).alias("marks"))
    return grouped.mapInArrow(_merge_marks(k), "doc_id long, fp long, cut_from array<long>, cut_to array<long>")


def with_ranges(docs: DataFrame, ranges: DataFrame, max_rows: int = 200_000, by_text: bool = True) -> DataFrame:
    """(doc_id, text, cut_from, cut_to) of every document; ``ranges`` is a stored table, broadcast while small."""
    found = small_or_shuffled(ranges, max_rows).select(F.col("doc_id").alias("r_id"), F.col("fp").alias("r_fp"), "cut_from", "cut_to")
    rows = keyed_texts(docs, by_text)
    on = rows["doc_id"].eqNullSafe(found["r_id"]) & (rows["fp"] == found["r_fp"])
    return rows.join(found, on, "left").select("doc_id", "text", "cut_from", "cut_to")
