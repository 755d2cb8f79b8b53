"""Best-fit packing by linear grouping.

Documents become token pieces of at most ``capacity`` tokens. How pieces share sequences depends on their lengths
only, so the plan is made from the length histogram (at most ``capacity`` numbers, however large the corpus):

1. large lengths are cut into groups of equal cardinality and rounded up to the longest length of their group;
2. for these few sizes, configurations (which sizes share a sequence) are chosen one after another: the largest
   size still open plus the knapsack-optimal choice of the others, used as often as the groups allow;
3. actual pieces replace the rounded sizes, which frees the rounding loss;
4. small pieces go, longest first, into the sequence with the tightest sufficient space.

The plan is a list of runs "pieces of length L with ranks r..r+n go to sequences s.., m in each". Spark ranks the
pieces inside their length, spread over all partitions, and looks the runs up by a broadcast join.
"""

from __future__ import annotations

import os
from bisect import bisect_left, insort
from collections import defaultdict
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, raw_texts, stored, tidy

CAPACITY = 2048
END_ID = 0
GROUPS = 96                  # sizes left after linear grouping
LARGE_ABOVE = 1 / 8          # pieces above this share of a sequence are large
CACHED_WORDS = 600_000       # words whose ids a Python worker keeps
VOCABULARY = "word_bpe_49k.json"

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


# ---------------------------------------------------------------- tokens

_TAIL = b".,!%&$#*"          # such characters after letters are a token run of their own in this vocabulary


class WordIds(dict):
    """UTF-8 word (A-Z lower-cased) -> its ids as little-endian uint32 bytes.

    This vocabulary drops white space and lower-cases, and none of its tokens crosses white space, so the ids of a
    text are the ids of its words one after another. Words are encoded once and remembered up to a bound.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        super().__init__()
        self.encode = Tokenizer.from_file(path).encode

    def ids(self, word: str) -> bytes:
        return np.array(self.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > CACHED_WORDS:
            self.clear()
        stem = word.rstrip(_TAIL)
        if len(stem) < len(word) and stem.isalpha():
            out = self[stem] + self[word[len(stem):]]
        else:
            out = self.ids(word.decode())
        self[word] = out
        return out

    def text_ids(self, raw: bytes) -> bytes:
        if b"<|" in raw:     # names of special tokens are told apart by case
            return b"".join(self.ids(w.decode()) for w in raw.split())
        return b"".join(map(self.__getitem__, raw.lower().split()))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def _tokenise(path: str, capacity: int, forget: bool):
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        try:
            yield from pieces(batches)
        finally:
            if forget:
                word_ids.cache_clear()

    def pieces(batches):
        ids = word_ids(path)
        for b in batches:
            rows = []
            for doc_id, raw in zip(b.column(0).to_pylist(), raw_texts(b.column(1))):
                data = ids.text_ids(raw) + end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at:at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, crc32(part)))
            cols = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, forget: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. Null or empty text: the end id alone.

    A Python worker keeps the vocabulary and the words it has met for its next task; with ``forget`` it gives them up
    at the end of each task, for jobs in which it does other work afterwards.
    """
    return id_and_text(docs).mapInArrow(tidy(_tokenise(path or vocabulary_path(), capacity, forget)), _PIECES)


# ---------------------------------------------------------------- plan (lengths only)

class _Runs:
    """Pieces of a group or length still to place, as runs (length, first rank, count), longest first."""

    def __init__(self, runs):
        self.runs = [list(r) for r in runs]

    def take(self, n: int):
        out = []
        while n:
            length, rank, have = self.runs[0]
            k = min(n, have)
            out.append((length, rank, k))
            n -= k
            if k == have:
                self.runs.pop(0)
            else:
                self.runs[0] = [length, rank + k, have - k]
        return out


def linear_groups(histogram: dict[int, int], groups: int):
    """[(rounded size, count, runs)]: consecutive lengths, longest first, in groups of equal cardinality."""
    total = sum(histogram.values())
    per = -(-total // groups) if total else 1
    out, runs, room = [], [], per
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            k = min(left, room)
            runs.append((length, rank, k))
            rank, left, room = rank + k, left - k, room - k
            if not room:
                out.append((runs[0][0], per, runs))
                runs, room = [], per
    if runs:
        out.append((runs[0][0], sum(r[2] for r in runs), runs))
    return out


def best_fill(sizes, counts, room: int):
    """How many of each size to take so that their sum is the largest one not above ``room`` (bounded knapsack)."""
    reach = np.full(room + 1, -1, np.int64)     # the last size used to reach a sum, in order of decreasing size
    reach[0] = len(sizes)
    steps = []
    for i, (s, c) in enumerate(zip(sizes, counts)):
        for _ in range(min(c, room // s if s else 0)):
            new = np.zeros(room + 1, bool)
            new[s:] = (reach[:-s] >= 0) & (reach[s:] < 0)
            if not new.any():
                break
            reach[new] = i
            steps.append(i)
    at, used = int(np.flatnonzero(reach >= 0)[-1]), defaultdict(int)
    while at:
        i = int(reach[at])
        used[i] += 1
        at -= sizes[i]
    return used


def configurations(sizes, counts, capacity: int):
    """[({size index: how often}, sequences)]: uses up all counts, the largest open size in every configuration."""
    counts, out = list(counts), []
    while any(counts):
        first = next(i for i, c in enumerate(counts) if c)
        rest = list(counts)
        rest[first] -= 1
        used = best_fill(sizes, rest, capacity - sizes[first])
        used[first] += 1
        used = {i: min(k, counts[i]) for i, k in used.items()}
        times = min(counts[i] // k for i, k in used.items())
        for i, k in used.items():
            counts[i] -= k * times
        out.append((used, times))
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large_above: float = LARGE_ABOVE):
    """Runs (length, rank_from, rank_to, sequence_from, per_sequence, offset) and the number of sequences."""
    out, bins = [], 0
    spaces: dict[int, list] = defaultdict(list)      # free space -> [(first sequence, count)]
    open_spaces: list[int] = []                      # its keys, sorted

    def add_space(free, first, n):
        if free and n:
            if free not in spaces or not spaces[free]:
                insort(open_spaces, free)
            spaces[free].append((first, n))

    large = {n: c for n, c in histogram.items() if n > large_above * capacity}
    grouped = linear_groups(large, groups)
    stock = [_Runs(g[2]) for g in grouped]
    for used, times in configurations([g[0] for g in grouped], [g[1] for g in grouped], capacity):
        slots = [_Runs(stock[i].take(times)) for i, k in sorted(used.items()) for _ in range(k)]
        while times:                                 # stretches in which no slot changes its actual length
            n = min(s.runs[0][2] for s in slots)
            offset = 0
            for s in slots:
                (length, rank, _), = s.take(n)
                out.append((length, rank, rank + n, bins, 1, offset))
                offset += length
            add_space(capacity - offset, bins, n)
            bins, times = bins + n, times - n

    for length in sorted((n for n in histogram if n not in large), reverse=True):
        rank, left = 0, histogram[length]
        while left:
            k = bisect_left(open_spaces, length)
            if k == len(open_spaces):                # no sequence has room: new ones
                per = capacity // length
                add_space(capacity, bins, -(-left // per))
                bins += -(-left // per)
                continue
            free = open_spaces[k]
            first, n = spaces[free].pop()
            if not spaces[free]:
                open_spaces.pop(k)
            per = min(free // length, left)
            take = min(n, left // per)
            add_space(free, first + take, n - take)
            add_space(free - per * length, first, take)
            out.append((length, rank, rank + take * per, first, per, capacity - free))
            rank, left = rank + take * per, left - take * per
    return out, bins


# ---------------------------------------------------------------- placement

def _number_rows(batches):
    """Adds (partition, place among the partition's pieces of equal length); the input is ordered by length."""
    part, last, n = TaskContext.get().partitionId(), None, 0
    for b in batches:
        lengths = np.asarray(b.column(3))
        place = np.empty(len(lengths), np.int64)
        if len(lengths):
            starts = np.flatnonzero(np.concatenate([[True], lengths[1:] != lengths[:-1]]))
            base = np.repeat(starts, np.diff(np.append(starts, len(lengths))))
            place = np.arange(len(lengths)) - base
            if lengths[0] == last:
                head = len(lengths) if len(starts) == 1 else starts[1]
                place[:head] += n
            last, n = lengths[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(place, pa.int64())],
                                         [*b.schema.names, "part", "place"])


def best_fit_pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, groups: int = GROUPS, forget: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Only documents of more than ``capacity`` tokens are cut, into full pieces and a last, maybe shorter one. A null
    text is empty (one piece: the end id). Repeated rows and equal ids are packed as documents of their own. No
    rows: no rows.
    """
    spark = docs.sparkSession
    pieces = stored(token_pieces(docs, path, capacity, forget), "token-pieces")
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, _ = plan(histogram, capacity, groups)
    ordered = pieces.repartitionByRange("length", "doc_id", "piece", "ids_crc32").sortWithinPartitions(
        "length", "doc_id", "piece", "ids_crc32")
    numbered = stored(ordered.mapInArrow(_number_rows, _PIECES + ", part int, place long"), "numbered-pieces")
    before = (numbered.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
              .select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("base")))
    ranked = numbered.join(before, ["length", "part"]).withColumn("rank", F.col("place") + F.col("base"))
    table = spark.createDataFrame(
        runs, "r_length long, rank_from long, rank_to long, sequence_from long, per_sequence long, at long")
    j = F.col("rank") - F.col("rank_from")
    placed = ranked.join(F.broadcast(table), (F.col("length") == F.col("r_length")) & (F.col("rank") >= F.col("rank_from"))
                         & (F.col("rank") < F.col("rank_to")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32",
                         (F.col("sequence_from") + F.floor(j / F.col("per_sequence"))).alias("sequence_id"),
                         (F.col("at") + (j % F.col("per_sequence")) * F.col("length")).alias("offset"))
