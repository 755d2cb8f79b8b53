"""Suffix-array dedup by external induced sorting: bytes inside 50-byte strings that an earlier document has are removed.

Shards: the 50-byte windows of all documents are dealt out by their minimiser (see ``super_kmers``); equal strings
of a batch travel once, with the places (document, position) where they stand, so that a shard answers every place
itself. Windows that could be equal are in one shard; minimisers that occur once in the corpus stay at home. A
minimiser that occurs ``HOT`` times or more could fill a shard alone: each of its windows goes its own way by its
128-bit name instead (partial minima and a join), so what one minimiser brings into a shard is bounded.

Inside a shard the suffixes of all strings are sorted by induction. The sorted S* suffixes (leftmost of ascending
runs) give the order of all L suffixes in one pass from the smallest character up, these give the S suffixes in a
pass down. A pass is a priority queue with one first-in-first-out run per first character; items are taken out in
batches, all of a character that are known, and a queue beyond ``QUEUE_ITEMS`` items continues in an unnamed
file of the task. The S* suffixes are sorted by first inducing the order of the substrings between them, naming
these, and ranking the names' suffixes in turn. Neighbours in the suffix order that share 50 bytes form the groups.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, ids_of, raw_texts, small_or_shuffled, stored, tidy
from .repeats import from_planes, planes, releasing, repeat_levels
from .super_kmers import (Scheme, byte_hashes, first_minimisers, ids_repeat, keyed_texts, minimiser_hashes, spread_hash,
                          string_name, with_ranges)

BYTES = 50
MINIMISER = 24
FILTER_BITS = 30             # 136 MB
QUEUE_ITEMS = 1 << 22        # positions a run of the queue keeps in memory
BUCKETS_PER_PARTITION = 4
HOT = 1 << 16                # occurrences from which on a minimiser's windows are dealt one by one
HOT_OWNERS = 200_000         # windows (24 bytes each) up to which the owners of hot ones are broadcast
SPAN = np.dtype([("first", "<u4"), ("n", "u1")])   # first window, consecutive windows
SPAN_WINDOWS = 255           # a longer run goes on in the next record
SIGMA = 257                  # end of a string, then the bytes

_SPANS = "doc_id long, fp long, spans binary"


class CharacterQueue:
    """Priority queue of positions by (first character, order of arrival), emptied a character at a time."""

    def __init__(self, limit: int = QUEUE_ITEMS):
        self.limit, self.runs, self.held, self.files = limit, [[] for _ in range(SIGMA)], [0] * SIGMA, {}

    def push(self, chars: np.ndarray, at: np.ndarray) -> None:
        order = np.argsort(chars, kind="stable")
        chars, at = chars[order], at[order]
        cut = np.flatnonzero(np.concatenate([[True], chars[1:] != chars[:-1]])) if len(chars) else []
        for c, part in zip(chars[cut].tolist() if len(chars) else [], np.split(at, cut[1:]) if len(chars) else []):
            self.runs[c].append(part)
            self.held[c] += len(part)
            if self.held[c] > self.limit:
                f = self.files.setdefault(c, tempfile.TemporaryFile())
                for x in self.runs[c]:
                    f.write(x.tobytes())
                self.runs[c], self.held[c] = [], 0

    def take(self, c: int) -> np.ndarray:
        parts = []
        if c in self.files:
            f = self.files.pop(c)
            f.seek(0)
            parts.append(np.frombuffer(f.read(), np.int64))
            f.close()
        parts += self.runs[c]
        self.runs[c], self.held[c] = [], 0
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def s_types(t: np.ndarray) -> np.ndarray:
    """Whether suffix i is smaller than suffix i + 1 (S); every end of a string is S and differs from the others."""
    up = np.concatenate([t[:-1] < t[1:], [True]]) | (t == 0)
    flat = np.concatenate([t[:-1] == t[1:], [False]]) & (t != 0)
    nxt = np.where(flat, len(t), np.arange(len(t)))
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]       # the next position whose type its own step decides
    return up[nxt]


def induce(t: np.ndarray, s: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """All suffixes of ``t`` in order, from its S* positions given in order."""
    before = CharacterQueue()
    before.push(t[seeds], seeds)
    l_queue, l_part = CharacterQueue(), [None] * SIGMA

    def step(batch, s_wanted):
        pred = batch[batch > 0] - 1
        pred = pred[s[pred] == s_wanted]
        return pred[t[pred] != 0]                      # the ends' order is given

    for c in range(SIGMA):
        done, batch = [], l_queue.take(c)
        while len(batch):
            done.append(batch)
            pred = step(batch, False)
            ch = t[pred]
            l_queue.push(ch[ch != c], pred[ch != c])
            batch = pred[ch == c]
        l_part[c] = np.concatenate(done) if done else np.zeros(0, np.int64)
        pred = step(before.take(c), False)
        l_queue.push(t[pred], pred)
    s_queue, out = CharacterQueue(), []
    s_queue.push(np.zeros(int((t == 0).sum()), np.int64), np.flatnonzero(t == 0)[::-1])
    for c in range(SIGMA - 1, -1, -1):
        batch, done = s_queue.take(c), []
        while len(batch):
            done.append(batch)
            pred = step(batch, True)
            ch = t[pred]
            s_queue.push(ch[ch != c], pred[ch != c])
            batch = pred[ch == c]
        pred = step(l_part[c][::-1], True)
        s_queue.push(t[pred], pred)
        if done:
            out.append(np.concatenate(done)[::-1])
        out.append(l_part[c])
    return np.concatenate(out[::-1])


def _name_stars(t: np.ndarray, star: np.ndarray, sorted_star: np.ndarray) -> np.ndarray:
    """Name (rank, ties for equal) of the substring from each S* position to the next one, in text order."""
    end = np.append(star[1:], len(t) - 1)
    length = np.zeros(len(t), np.int64)
    length[star] = end - star + 1
    a, b = sorted_star[:-1], sorted_star[1:]
    same = (length[a] == length[b]) & (t[a] != 0)
    left, i = np.flatnonzero(same), 0
    while len(left):
        x, y = a[left] + i, b[left] + i
        equal = t[x] == t[y]
        same[left[~equal]] = False
        left, i = left[equal], i + 1
        left = left[length[a[left]] > i]
    name = np.zeros(len(t), np.int64)
    name[sorted_star] = np.concatenate([[0], np.cumsum(~same)])
    return name[star]


def _rank_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of the names' string: pairs of ranks are ranked again, twice the depth each time."""
    rank, span = names, 1
    while True:
        n = int(rank.max()) + 1
        if n == len(rank):
            return np.argsort(rank)
        following = np.concatenate([rank[span:] + 1, np.zeros(min(span, len(rank)), np.int64)])
        _, rank = np.unique(rank * (n + 1) + following, return_inverse=True)
        span *= 2


def suffix_order(t: np.ndarray) -> np.ndarray:
    """Suffix array of strings over 1..256 laid end to end, each closed by a 0 (earlier ends sort first)."""
    s = s_types(t)
    star = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    if not len(star):
        return induce(t, s, star)
    rough = induce(t, s, star)
    is_star = np.zeros(len(t), bool)
    is_star[star] = True
    names = _name_stars(t, star, rough[is_star[rough]])
    return induce(t, s, star[_rank_names(names)])


def smallest_owner(items: list[bytes], number: np.ndarray, k: int):
    """For the windows of all strings: (string, place in it, smallest ``number`` of a string that has the window)."""
    n_windows = np.array([len(x) - k + 1 for x in items])
    size = np.array([len(x) + 1 for x in items])
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    raw = np.frombuffer(b"\0".join(items) + b"\0" * 9, np.uint8)
    t = raw[:int(size.sum())].astype(np.int64) + 1
    t[begin + size - 1] = 0
    owner_of = np.repeat(np.arange(len(items)), size)
    place_of = np.arange(len(t)) - begin[owner_of]
    order = suffix_order(t)
    order = order[place_of[order] < n_windows[owner_of[order]]]
    words = np.zeros(len(t), np.uint64)                # eight bytes from each position
    for i in range(8):
        words |= raw[i:len(t) + i].astype(np.uint64) << np.uint64(8 * i)
    a, b = order[:-1], order[1:]
    shared = np.ones(len(a), bool)                     # neighbours that share k bytes
    for at in [*range(0, k - 7, 8), k - 8]:
        shared &= words[a + at] == words[b + at]
    group = np.concatenate([[0], np.cumsum(~shared)]) if len(order) else np.zeros(0, np.int64)
    low = np.full(int(group[-1]) + 1 if len(group) else 0, NULL_ID, np.int64)
    np.minimum.at(low, group, number[owner_of[order]])
    return owner_of[order], place_of[order], low[group]


def _apart(items: list[bytes], scheme: Scheme) -> np.ndarray:
    """Whether no other string has the string's minimiser, so that none of its windows is in another string."""
    if not items:
        return np.zeros(0, bool)
    heads = byte_hashes(b"".join(x[:scheme.k] for x in items)).reshape(len(items), scheme.k)
    _, which, n = np.unique(first_minimisers(heads, scheme.m), return_inverse=True, return_counts=True)
    return n[which] == 1


def pack_strings(strings: list[bytes], which, doc, first, ids, fps) -> bytes:
    """Distinct strings and their places, compressed: place i is string ``which[i]`` at ``first[i]`` of document ``doc[i]``.

    ``doc`` ascends; ``ids`` and ``fps`` name the documents it counts.
    """
    head = np.array([len(strings), len(which), len(ids)], "<i8").tobytes()
    lens = np.fromiter(map(len, strings), np.int64, len(strings))
    body = [head, planes(lens), planes(which), planes(np.diff(doc, prepend=0)), planes(first),
            np.diff(ids, prepend=np.int64(0)).astype("<i8").tobytes(), fps.astype("<i8").tobytes(), *strings]
    return zstandard.ZstdCompressor(3).compress(b"".join(body))


def unpack_strings(blob: bytes):
    data = zstandard.ZstdDecompressor().decompress(blob)
    n, m, d = np.frombuffer(data, "<i8", 3).tolist()
    lens, which = from_planes(data, n, 24), from_planes(data, m, 24 + 4 * n)
    doc, first = np.cumsum(from_planes(data, m, 24 + 4 * (n + m))), from_planes(data, m, 24 + 4 * (n + 2 * m))
    at = 24 + 4 * (n + 3 * m)
    ids, fps = np.cumsum(np.frombuffer(data, "<i8", d, at)), np.frombuffer(data, "<i8", d, at + 8 * d)
    cut = np.concatenate([[0], np.cumsum(lens)]) + at + 16 * d
    return [data[a:z] for a, z in zip(cut[:-1].tolist(), cut[1:].tolist())], which, doc, first, ids, fps


def _runs(scheme: Scheme, table, raw: bytes):
    """(hashes, firsts, lengths in windows, hot or not) of a text's runs whose minimiser may occur elsewhere."""
    minimisers, first, count = scheme.runs(byte_hashes(raw))
    hashes = spread_hash(minimisers)
    may = table.may_repeat(hashes)
    hashes, first, count = hashes[may], first[may], count[may]
    return hashes, first, count, table.hot(hashes)


def _deal(scheme: Scheme, levels, n_buckets: int):
    """Batches of (doc_id, text, fp) -> rows (bucket, packed strings): each string once per batch, with all its places."""
    def run(batches):
        for b in batches:
            ids, fps = np.array(ids_of(b.column(0)), np.int64), np.array(b.column(2).to_pylist(), np.int64)
            index: dict[bytes, int] = {}
            home, which, doc, first = [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, raw in enumerate(raw_texts(b.column(1))):
                hashes, at, n, hot = _runs(scheme, levels.value, raw)
                at, last = at[~hot], (at + n + scheme.k - 1)[~hot]
                for h, x, y in zip((hashes[~hot] % np.uint64(n_buckets)).tolist(), at.tolist(), last.tolist()):
                    s = raw[x:y]
                    j = index.setdefault(s, len(home))
                    if j == len(home):
                        home.append(h)
                    which.append(j)
                doc.append(np.full(len(at), i, np.int64))
                first.append(at)
            items, home, which = list(index), np.array(home, np.int64), np.array(which, np.int64)
            doc, first = np.concatenate(doc), np.concatenate(first)
            place_home = home[which]
            by_home, by_place = np.argsort(home, kind="stable"), np.argsort(place_home, kind="stable")
            local = np.empty(len(home), np.int64)
            buckets, starts = np.unique(home[by_home], return_index=True)
            owned = []
            for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(home)]):
                own = by_home[at:end]
                local[own] = np.arange(len(own))
                owned.append(own)
            edges = np.searchsorted(place_home[by_place], np.append(buckets, n_buckets))
            out = []
            for own, x, y in zip(owned, edges[:-1], edges[1:]):
                at = by_place[x:y]
                rows, mine = np.unique(doc[at], return_inverse=True)
                out.append(pack_strings([items[j] for j in own], local[which[at]], mine, first[at], ids[rows], fps[rows]))
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(out, pa.binary())], ["bucket", "strings"])
    return run


class Shard:
    """The distinct strings of a bucket and all their places."""

    def __init__(self):
        self.index: dict[bytes, int] = {}
        self.parts = []

    def add(self, blob: bytes) -> None:
        strings, which, doc, first, ids, fps = unpack_strings(blob)
        name = np.array([self.index.setdefault(s, len(self.index)) for s in strings], np.int64)
        self.parts.append((name[which].astype(np.int32), first.astype(np.int32), ids[doc], fps[doc]))

    def marks(self, scheme: Scheme):
        """(doc_id, fp, place of a window) for the windows that an earlier document has."""
        which, first, ids, fps = (np.concatenate(x) for x in zip(*self.parts))
        items = list(self.index)
        low_id, high_id = np.full(len(items), NULL_ID, np.int64), np.full(len(items), np.iinfo(np.int64).min)
        np.minimum.at(low_id, which, ids)
        np.maximum.at(high_id, which, ids)
        apart = _apart(items, scheme)
        n = np.array([len(x) - scheme.k + 1 for x in items])
        single = np.flatnonzero(apart)
        string, mask, low = [single], [(np.int64(1) << n[single]) - 1], [low_id[single]]
        shared = np.flatnonzero(~apart)
        if len(shared):
            owner, place, least = smallest_owner([items[j] for j in shared], low_id[shared], scheme.k)
            owner = shared[owner]
            use = least < high_id[owner]               # else no document of the string is later than the owner
            owner, place, least = owner[use], place[use], least[use]
            order = np.lexsort((least, owner))
            owner, place, least = owner[order], place[order], least[order]
            if len(owner):
                new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (least[1:] != least[:-1])]))
                string.append(owner[new])
                mask.append(np.bitwise_or.reduceat(np.int64(1) << place, new))
                low.append(least[new])
        string, mask, low = np.concatenate(string), np.concatenate(mask), np.concatenate(low)
        order = np.argsort(string, kind="stable")
        mask, low = mask[order], low[order]
        begin = np.searchsorted(string[order], np.arange(len(items) + 1))
        found, marks = np.zeros(len(which), np.int64), np.diff(begin)[which]
        for step in range(int(marks.max(initial=0))):  # one finding of each place's string at a time
            has = np.flatnonzero(marks > step)
            at = begin[which[has]] + step
            later = low[at] < ids[has]
            found[has[later]] |= mask[at[later]]
        hit = np.flatnonzero(found)
        row, bit = np.nonzero(np.unpackbits(found[hit].astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        return ids[hit][row], fps[hit][row], first[hit][row].astype(np.int64) + bit


def _spans(ids, fps, windows) -> pa.RecordBatch:
    """Covered windows -> one row per document: doc_id, fp, its runs of windows as ``SPAN`` records."""
    order = np.lexsort((windows, fps, ids))
    ids, fps, windows = ids[order], fps[order], windows[order]
    other = np.concatenate([[True], (ids[1:] != ids[:-1]) | (fps[1:] != fps[:-1])])
    fresh = other | np.concatenate([[True], windows[1:] != windows[:-1]])
    ids, fps, windows, other = ids[fresh], fps[fresh], windows[fresh], other[fresh]
    gap = other | np.concatenate([[True], windows[1:] != windows[:-1] + 1])
    inside = np.arange(len(windows)) - np.maximum.accumulate(np.where(gap, np.arange(len(windows)), 0))
    new = np.flatnonzero(inside % SPAN_WINDOWS == 0)
    spans = np.zeros(len(new), SPAN)
    spans["first"], spans["n"] = windows[new], np.diff(np.append(new, len(windows)))
    begin = np.flatnonzero(other)
    offsets = np.append(np.searchsorted(new, begin), len(new)).astype(np.int32) * SPAN.itemsize
    packed = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(spans.tobytes())])
    ids, fps = ids[begin], fps[begin]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=ids == NULL_ID), pa.array(fps, pa.int64()), packed],
                                      ["doc_id", "fp", "spans"])


def _shard_spans(scheme: Scheme):
    """Batches ordered by bucket -> the covered spans of each bucket."""
    def rows(shard):
        ids, fps, windows = shard.marks(scheme)
        if len(ids):
            yield _spans(ids, fps, windows)

    def run(batches):
        at, shard = None, None
        for b in batches:
            for bucket, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if bucket != at:
                    if shard:
                        yield from rows(shard)
                    at, shard = bucket, Shard()
                shard.add(blob)
        if shard:
            yield from rows(shard)
    return run


def _window_spans(batches):
    """Batches of (doc_id, fp, first), a window a row -> spans."""
    for b in batches:
        if b.num_rows:
            yield _spans(np.array(ids_of(b.column(0)), np.int64), np.asarray(b.column(1)), np.asarray(b.column(2)))


def _merge_spans(k: int):
    """(doc_id, fp, [spans]) -> (doc_id, fp, from, to): maximal covered byte ranges."""
    def run(batches):
        for b in batches:
            froms, tos = [], []
            for parts in b.column(2).to_pylist():
                spans = np.frombuffer(b"".join(parts), SPAN)
                spans = spans[np.argsort(spans["first"], kind="stable")]
                a = spans["first"].astype(np.int64)
                end = np.maximum.accumulate(a + spans["n"] + (k - 1))
                new = np.flatnonzero(np.concatenate([[True], a[1:] > end[:-1]]))
                froms.append(a[new].tolist())
                tos.append(end[np.append(new[1:], len(a)) - 1].tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(froms, pa.list_(pa.int64())),
                                              pa.array(tos, pa.list_(pa.int64()))], ["doc_id", "fp", "cut_from", "cut_to"])
    return run


def _hot_windows(scheme: Scheme, levels):
    """Batches of (doc_id, text, fp) -> rows (doc_id, fp, first, 128-bit name) of the windows with a hot minimiser."""
    def run(batches):
        for b in batches:
            sizes, firsts, names = [], [np.zeros(0, np.int64)], []
            for raw in raw_texts(b.column(1)):
                _, first, n, hot = _runs(scheme, levels.value, raw)
                first, n = first[hot], n[hot]
                at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                sizes.append(len(at))
                firsts.append(at)
                names += [string_name(raw[x:x + scheme.k]) for x in at.tolist()]
            row = pa.array(np.repeat(np.arange(b.num_rows), sizes), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(row), b.column(2).take(row), pa.array(np.concatenate(firsts)), pa.array(names, pa.binary())],
                ["doc_id", "fp", "first", "string"])
    return run


def _hot_spans(texts: DataFrame, scheme: Scheme, levels) -> DataFrame:
    """Spans of the windows with a hot minimiser: their owners by partial minima, met by a join on the window's name."""
    rows = stored(texts.mapInArrow(releasing(levels, _hot_windows(scheme, levels)), "doc_id long, fp long, first long, string binary"),
                  "hot-windows")
    number = F.coalesce("doc_id", F.lit(NULL_ID))
    owners = stored(rows.groupBy("string").agg(F.min(number).alias("low"), F.max(number).alias("high"))
                    .where(F.col("low") < F.col("high")).select("string", "low"), "hot-owners")
    return (rows.join(small_or_shuffled(owners, HOT_OWNERS), "string").where(number > F.col("low"))
            .select("doc_id", "fp", "first").mapInArrow(_window_spans, _SPANS))


def earlier_ranges(docs: DataFrame, scheme: Scheme, hot: int = HOT, by_text: bool = True) -> DataFrame:
    """doc_id, fp, cut_from, cut_to (byte positions) covered by a string that a document with a smaller id has.

    ``by_text`` as in :func:`keyed_texts`: a shard's packs name every document they touch, so eight bytes of
    fingerprint for each of them are a good part of what is shuffled.
    """
    levels = repeat_levels(docs, minimiser_hashes(scheme), scheme.filter_bits, hot)
    texts = keyed_texts(docs, by_text)
    n_buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * BUCKETS_PER_PARTITION
    spans = (texts.mapInArrow(releasing(levels, _deal(scheme, levels, n_buckets)), "bucket int, strings binary")
             .repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(_shard_spans(scheme)), _SPANS))
    if levels.value.any_hot():
        spans = spans.unionByName(_hot_spans(texts, scheme, levels))
    merged = (spans.groupBy("doc_id", "fp").agg(F.collect_set("spans").alias("spans"))
              .mapInArrow(_merge_spans(scheme.k), "doc_id long, fp long, cut_from array<long>, cut_to array<long>"))
    return stored(merged, "earlier-ranges")


def _cut_bytes(batches):
    for b in batches:
        out = []
        for doc_id, raw, a, z in zip(b.column(0).to_pylist(), raw_texts(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist()):
            kept, at, gone = [], 0, 0
            for x, y in zip(a or (), z or ()):
                kept.append(raw[at:x])
                at, gone = y, gone + y - x
            rest = b"".join([*kept, raw[at:]])
            out.append((doc_id, rest, len(raw), gone, len(a or ()), hashlib.sha256(rest).hexdigest()))
        cols = list(zip(*out)) or [()] * 6
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                         ["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_earlier_strings(docs: DataFrame, k: int = BYTES, m: int = MINIMISER, filter_bits: int = FILTER_BITS,
                           hot: int = HOT) -> DataFrame:
    """doc_id, kept (bytes), n_bytes, n_removed, n_spans, kept_sha256, one row per document.

    Rows with the same id are the same document for this purpose (neither is earlier); a null id is later than
    every number. Null text: empty. Texts under ``k`` bytes stay. No rows: no rows.
    """
    by_text = ids_repeat(docs)
    cut = with_ranges(docs, earlier_ranges(docs, Scheme(k, m, False, filter_bits), hot, by_text), by_text=by_text)
    return cut.mapInArrow(_cut_bytes, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
