"""SimHash near-duplicates by anchor points of a covering code.

A text's fingerprint has a bit set where more than half of its shingles' 64-bit hashes have it. Two fingerprints link
at 3 or fewer differing bits (``DISTANCE``; the anchors below are made for it). Of such a pair, one 32-bit half differs in at most one bit, the
*threshold* of a half. Anchors are the codewords of the perfect [31, 26] Hamming code on the first 31 bits of a half:
its covering radius is 1, so every fingerprint has a *home* anchor within 1 bit, and a partner lies within radius +
threshold = 2 bits of that home. Each distinct fingerprint is therefore replicated to all anchors within 2 bits, 16 at
most for a half, and every anchor compares the fingerprints at home there with all that were sent there.

* Works on distinct fingerprints: a group of copies is one, however large.
* An anchor reports links that connect its fingerprints, no more than a few per fingerprint, never all its pairs.
* An anchor with more than ``most`` fingerprints is not compared in one task. Its fingerprints go to finer anchors, for
  which every point of the space serves: a pair at 3 bits or fewer has a point within 1 bit of one and 2 of the other.
  Whatever meets at a point with one side within 1 bit links without any comparison, and a point has 2081
  fingerprints within 2 bits at the very most, whatever the corpus.

Connectivity is exact: every linked pair of different fingerprints is found or already connected.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, id_and_text, id_or_null, raw_texts, small_or_shuffled, stored
from .multi_order_join import connect

SHINGLE = 3
SEED = 42
DISTANCE = 3
MOST = 4096               # fingerprints compared at one anchor
_CHUNK = 255 * 256        # shingles whose bits are counted at a time; 255 fit the byte counters

_U = np.uint64
_CODE_BITS = 31
_CODE_MASK = (1 << _CODE_BITS) - 1


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255
    sums = bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return sums + bits[whole:].sum(axis=0, dtype=np.int64)


def simhash(raw: bytes, size: int = SHINGLE) -> int:
    """64-bit fingerprint of a text's word shingles (A-Z lower-cased, repeats count); 0 without words."""
    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    size = min(size, len(words))
    starts = np.concatenate([[0], ends[:-1]])[:len(words) - size + 1]
    ends = ends[size - 1:] - 1
    hash_of, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), _CHUNK):
        part = zip(starts[at:at + _CHUNK].tolist(), ends[at:at + _CHUNK].tolist())
        ones += _bit_counts(np.array([hash_of(joined[a:z], SEED) for a, z in part], np.uint64))
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def _fingerprints(size: int):
    def run(batches):
        for b in batches:
            prints = np.array([simhash(raw, size) for raw in raw_texts(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], ["doc_id", "print"])
    return run


@lru_cache(maxsize=1)
def _flips() -> np.ndarray:
    """Row s: what to flip in a word of syndrome s to reach each codeword within 2 bits, home first; -1: none left."""
    table = np.full((32, 16), -1, np.int64)
    table[0, 0] = 0
    for s in range(1, 32):
        pairs = [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i < i ^ s]
        table[s, :16] = [1 << (s - 1), *pairs]
    return table


def anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, index of the fingerprint, whether the anchor is its home) of all anchors within 2 bits in either half."""
    out = []
    for half in (0, 1):
        word = ((prints >> _U(32 * half)) & _U(_CODE_MASK)).astype(np.int64)
        syndrome = np.zeros(len(word), np.int64)
        for i in range(1, _CODE_BITS + 1):
            syndrome ^= np.where((word >> (i - 1)) & 1 == 1, i, 0)
        flips = _flips()[syndrome]
        row, col = np.nonzero(flips >= 0)
        out.append(((word[row] ^ flips[row, col]) | (half << _CODE_BITS), row, col == 0))
    return tuple(np.concatenate(c) for c in zip(*out))


def _replicate(batches):
    """print -> (anchor, print, home)."""
    for b in batches:
        prints = b.column(0).to_numpy(zero_copy_only=False)
        at, row, home = anchors(prints.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(prints[row]), pa.array(home)], ["anchor", "print", "home"])


def connecting_links(prints: np.ndarray, home: np.ndarray) -> list[tuple[int, int]]:
    """Links among an anchor's fingerprints that connect what the links home x all connect."""
    bits = prints.view(np.uint64)          # bitwise_count takes the absolute value of signed numbers
    group, out = np.full(len(prints), -1), []
    for i in np.flatnonzero(home).tolist():
        hit = np.flatnonzero(np.bitwise_count(bits ^ bits[i]) <= DISTANCE)
        if len(hit) < 2:
            continue
        known, first = np.unique(group[hit], return_index=True)
        roots, met, fresh = known[known >= 0], hit[first[known >= 0]], hit[group[hit] < 0]
        out += [(i, j) for j in [*fresh.tolist(), *met.tolist()] if j != i]
        root = int(roots[0]) if len(roots) else i
        group[fresh] = root
        if len(roots) > 1:
            group[np.isin(group, roots)] = root
    return out


def _group_links(at: np.ndarray, prints: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
    edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]])) if len(at) else np.zeros(1, np.int64)
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for g in np.flatnonzero(np.diff(edge) > 1).tolist():
        part = slice(edge[g], edge[g + 1])
        if found := connecting_links(prints[part], home[part]):
            a, b = np.array(found).T
            out_a.append(prints[part][a])
            out_b.append(prints[part][b])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])


def _compare(batches):
    """Rows (anchor, print, home) ordered by anchor -> links (a, b); a group may go on in the next batch."""
    kept = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if kept is not None:
            cols = [np.concatenate(pair) for pair in zip(kept, cols)]
        last = int(np.searchsorted(cols[0], cols[0][-1]))
        yield _group_links(*(c[:last] for c in cols))
        kept = [c[last:] for c in cols]
    if kept is not None:
        yield _group_links(*kept)


@lru_cache(maxsize=2)
def _near_points(half: int) -> tuple[np.ndarray, np.ndarray]:
    """What to flip to reach the finer anchors of a fingerprint hot in ``half``, and which are within 1 bit."""
    own, other = ([1 << i for i in range(32 * h, 32 * h + 32)] for h in (half, 1 - half))
    one = [0, *other, *own]
    two = [a | b for a, b in combinations(other, 2)]
    return np.array(one + two, np.uint64), np.arange(len(one) + len(two)) < len(one)


def _finer(batches):
    """(half, print) -> (point, print, close) of the points within 1 bit, and within 2 bits in the other half."""
    for b in batches:
        half, prints = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        for h in (0, 1):
            some = prints[half == h]
            flips, close = _near_points(h)
            for at in range(0, len(some), 4096):
                part = some[at:at + 4096]
                points = (part.view(np.uint64)[:, None] ^ flips[None, :]).reshape(-1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(points), pa.array(np.repeat(part, len(flips))), pa.array(np.tile(close, len(part)))],
                    ["point", "print", "close"])


def _hot_links(rows: DataFrame) -> DataFrame:
    """Links (a, b) among fingerprints of hot anchors. ``rows``: anchor, print, home."""
    hot = rows.select(F.shiftright("anchor", _CODE_BITS).cast("int").alias("half"), "print").distinct()
    points = hot.mapInArrow(_finer, "point long, print long, close boolean")
    met = (points.groupBy("point").agg(F.min(F.when(F.col("close"), F.col("print"))).alias("a"), F.collect_set("print").alias("near"))
           .where(F.col("a").isNotNull() & (F.size("near") > 1)))
    return met.select("a", F.explode("near").alias("b")).where("a <> b")


def fingerprint_links(prints: DataFrame, most: int = MOST) -> DataFrame:
    """Links (a, b) that connect all of the distinct fingerprints ``prints`` (column ``print``, a stored table)."""
    rows = prints.select("print").mapInArrow(_replicate, "anchor long, print long, home boolean")
    full = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    hot = stored(full.select("anchor"), "hot-anchors")
    some_hot = not hot.isEmpty()
    calm = rows.join(small_or_shuffled(hot, 200_000), "anchor", "left_anti") if some_hot else rows
    links = (calm.repartition("anchor").sortWithinPartitions("anchor")
             .mapInArrow(_compare, "a long, b long"))
    if some_hot:
        links = links.unionByName(_hot_links(rows.join(small_or_shuffled(hot, 200_000), "anchor", "left_semi")))
    return stored(links.distinct(), "print-links")


def simhash_components(docs: DataFrame, size: int = SHINGLE, most: int = MOST) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id for every document.

    component_id is the smallest doc_id reachable by links. A null or empty text, or one without words, has fingerprint
    0 and links like any other. Equal fingerprints, and so repeated rows, are linked. A null doc_id is larger than any
    number; component_id is null only where every doc_id of the component is. No rows: no rows.
    """
    marked = stored(id_and_text(docs).mapInArrow(_fingerprints(size), "doc_id long, print long"), "prints")
    ident = F.coalesce("doc_id", F.lit(NULL_ID))
    classes = stored(marked.groupBy("print").agg(F.min(ident).alias("low"), F.count(F.lit(1)).alias("n")), "print-classes")
    links = fingerprint_links(classes, most)
    nodes = stored(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")), "linked-prints")
    labels = connect(nodes, links)
    both = classes.join(labels.select(F.col("node").alias("print"), "label"), "print", "left")
    grouped = both.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("low").alias("least"))
    # a document alone in its class and without links is its own component: it needs no partner here
    found = (both.where(F.col("label").isNotNull() | (F.col("n") > 1)).join(grouped, "label", "left")
             .select("print", F.coalesce("least", "low").alias("least")))
    return (marked.join(found, "print", "left")
            .select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
                    id_or_null(F.coalesce("least", ident)).alias("component_id")))
