"""Bitmaps and counters of fixed size over all documents' hashes.

``repeat_filter`` marks the places of a bitmap that two or more hashes fall on: what may occur twice. A value
whose place is not marked occurs once. ``count_sketch`` has rough counts instead. Each task sends, for every batch,
the sorted places it hit; a place's slice of the table is put together in one task, from packed lists. The
finished table has a size set by its parameter alone, so it may be collected and broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from ..functions.passes import then
from .common import id_and_text, raw_texts, tidy

SLICES = 256
_U = np.uint64


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Places of even 64-bit hashes in a table of 2^bits."""
    return (hashes >> _U(64 - bits)).astype(np.int64)


def planes(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, a byte of all of them after the other: small numbers compress well so."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(data: bytes, n: int, at: int = 0) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * n, at).reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(planes(values)) if len(values) else b""


def _unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.int64)
    data = zstandard.ZstdDecompressor().decompress(blob)
    return from_planes(data, len(data) // 4)


def _place_lists(hashes_of, column: int, bits: int, most: int):
    """Per batch and slice: the places hit, as packed steps, and how often (``most`` at most), packed.

    Without a column, ``hashes_of`` is given the whole batch.
    """
    per_slice = 1 << (bits - 8)

    def run(batches):
        for b in batches:
            found = [places(hashes_of(x), bits) for x in ([b] if column is None else raw_texts(b.column(column)))]
            at, n = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_counts=True)
            n = np.minimum(n, most)
            edge = np.searchsorted(at, np.arange(SLICES + 1) * per_slice)
            rows = [(i, _pack(np.diff(at[x:y], prepend=i * per_slice)), _pack(n[x:y]))
                    for i, (x, y) in enumerate(zip(edge[:-1], edge[1:])) if y > x]
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()),
                                              pa.array(cols[2], pa.binary())], ["slice", "steps", "n"])
    return run


def _slices(bits: int, finish):
    """Rows ordered by slice -> one row per slice with ``finish(counts)``, packed."""
    def run(batches):
        at, total = None, None

        def done():
            blob = zstandard.ZstdCompressor(3).compress(finish(total).tobytes())
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([blob], pa.binary())], ["slice", "body"])

        for b in batches:
            for i, steps, n in zip(*(b.column(c).to_pylist() for c in range(3))):
                if i != at:
                    if at is not None:
                        yield done()
                    at, total = i, np.zeros(1 << (bits - 8), np.int32)
                where = np.cumsum(_unpack(steps))
                total[where] = np.minimum(total[where] + _unpack(n), np.iinfo(np.int32).max)
        if at is not None:
            yield done()
    return run


class Table:
    """A table of 2^bits places in packed slices, opened in the worker that uses it."""

    def __init__(self, bits: int, width: int, slices: dict[int, bytes]):
        self.bits, self.width, self.slices, self._flat = bits, width, slices, None

    def __getstate__(self):
        return self.bits, self.width, self.slices

    def __setstate__(self, state):
        (self.bits, self.width, self.slices), self._flat = state, None

    def slice_bytes(self) -> int:
        return (1 << (self.bits - 8)) * self.width // 8

    def flat(self) -> np.ndarray:
        if self._flat is None:
            size = self.slice_bytes()
            flat = np.zeros(size * SLICES, np.uint8)
            for i, blob in self.slices.items():
                flat[i * size:(i + 1) * size] = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
            self._flat = flat
        return self._flat

    def release(self) -> None:
        """Give the opened table back; it opens again when next read."""
        self._flat = None

    def may_repeat(self, hashes: np.ndarray) -> np.ndarray:
        at = places(hashes, self.bits)
        return (self.flat()[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1

    def level(self, hashes: np.ndarray) -> np.ndarray:
        return self.flat()[places(hashes, self.bits)]


COARSE = 4                     # log2 of the places that share a bit of the bitmap of hot ones


class LevelTable(Table):
    """Two bitmaps in every slice: places hit twice or more, and runs of 16 places of which one is hit so often that it is hot."""

    def slice_bytes(self) -> int:
        return super().slice_bytes() + (super().slice_bytes() >> COARSE)

    def _bit(self, at: np.ndarray, begin: int) -> np.ndarray:
        slices, inside = at
        byte = slices * self.slice_bytes() + begin + (inside >> 3)
        return (self.flat()[byte] >> (7 - (inside & 7)).astype(np.uint8)) & 1 == 1

    def _split(self, hashes: np.ndarray):
        at = places(hashes, self.bits)
        return at >> (self.bits - 8), at & ((1 << (self.bits - 8)) - 1)

    def may_repeat(self, hashes: np.ndarray) -> np.ndarray:
        return self._bit(self._split(hashes), 0)

    def hot(self, hashes: np.ndarray) -> np.ndarray:
        slices, inside = self._split(hashes)
        return self._bit((slices, inside >> COARSE), super().slice_bytes())

    def any_hot(self) -> bool:
        begin = super().slice_bytes()
        return any(zstandard.ZstdDecompressor().decompress(x)[begin:].strip(b"\0") for x in self.slices.values())


def releasing(table, run):
    """``run``, a function over batches that reads a broadcast table, with the opened table given back at the task's end."""
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            table.value.release()
    return tidy(wrapped)


def _twice(total):
    return np.packbits(total > 1)


def _log_count(total):
    return np.where(total > 0, 1 + np.round(8 * np.log2(np.maximum(total, 1))), 0).astype(np.uint8)


def _once(total):
    return np.packbits(total > 0)


def _table(rows: DataFrame, hashes_of, column: int | None, bits: int, width: int, finish, most: int, kind=Table, before=iter):
    lists = rows.mapInArrow(tidy(then(before, _place_lists(hashes_of, column, bits, most))), "slice int, steps binary, n binary")
    got = (lists.repartition("slice").sortWithinPartitions("slice")
           .mapInArrow(tidy(_slices(bits, finish)), "slice int, body binary").collect())
    return rows.sparkSession.sparkContext.broadcast(kind(bits, width, {r["slice"]: bytes(r["body"]) for r in got}))


def repeat_filter(docs: DataFrame, hashes_of, bits: int, choose=iter):
    """Broadcast bitmap of 2^bits / 8 bytes at most: which of ``hashes_of(text)`` of all documents may occur twice.

    ``choose``, a function over the batches of ``docs``, leaves those that count.
    """
    return _table(docs if choose is not iter else id_and_text(docs), hashes_of, 1, bits, 1, _twice, 2, before=choose)


def seen_filter(rows: DataFrame, hashes_of, bits: int):
    """Broadcast bitmap of 2^bits / 8 bytes at most: which of ``hashes_of(batch)`` may occur in ``rows`` (``may_repeat`` tells)."""
    return _table(rows, hashes_of, None, bits, 1, _once, 1)


def repeat_levels(docs: DataFrame, hashes_of, bits: int, hot: int):
    """Broadcast ``LevelTable`` of 17/16 * 2^bits / 8 bytes: what may occur twice, and what may occur ``hot`` times or more."""
    def finish(total):
        return np.concatenate([np.packbits(total > 1), np.packbits((total >= hot).reshape(-1, 1 << COARSE).any(axis=1))])
    return _table(id_and_text(docs), hashes_of, 1, bits, 1, finish, hot, LevelTable)


def count_sketch(rows: DataFrame, hashes_of, column: int, bits: int):
    """Broadcast table of 2^bits bytes: 1 + 8 log2(count) of each place's hashes, over a binary column of ``rows``."""
    return _table(rows, hashes_of, column, bits, 8, _log_count, 1 << 31)
