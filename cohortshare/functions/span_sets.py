"""Sets of entity spans in Arrow batches: the spans of one key in one block of tokens are one row of bytes.

A span's row would carry its key, positions and type through the shuffle by itself. A pack carries the key once, and
each span in ``SMALL`` (or ``WIDE``) bytes beside the names of the pack's own types. Packs of the same key and block
meet in one task, in order, and are reduced to their distinct spans as they pass; so what is opened is a portion of
a batch, and what is held the distinct spans of one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import passes
from .islands import kinds_of_rows, portions, text_sizes

BLOCK_BITS = 12              # a block is 4,096 token positions
BYTES = 1 << 21              # bytes of packed spans opened at a time; a longer pack alone
NOWHERE = -(1 << 40)         # stands for a null position
SMALL = np.dtype([("start", "<u2"), ("length", "<u2"), ("type", "<u2")])
WIDE = np.dtype([("start", "<u2"), ("length", "<i8"), ("type", "<i4")])
PACK = "block long, pred boolean, types array<string>, wide boolean, data binary"


def _codes(column: pa.Array) -> np.ndarray:
    """A number for each value, the same for equal ones (nulls as well)."""
    if pa.types.is_nested(column.type):
        seen: dict = {}
        return np.array([seen.setdefault(repr(v), len(seen)) for v in column.to_pylist()], np.int64)
    return column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def _heads(columns: list[pa.Array], n: int) -> np.ndarray:
    """Whether a row differs from the one before it."""
    new = np.zeros(n, bool)
    new[:1] = True
    for codes in map(_codes, columns):
        new[1:] |= codes[1:] != codes[:-1]
    return new


def _one_number(columns: list[np.ndarray]) -> np.ndarray:
    """Rows of numbers as one number each, equal for equal rows and in their order."""
    key, size = np.zeros(len(columns[0]), np.int64), 1
    for c in columns:
        c = c.astype(np.int64) - int(c.min())
        if int(c.max()) >= 1 << 31:
            c = np.unique(c, return_inverse=True)[1]
        width = int(c.max()) + 1
        if size * width >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
            size = int(key.max()) + 1
        key, size = key * width + c, size * width
    return key


def _packed(shared: list[pa.Array], names: list[str], pred: np.ndarray, row: np.ndarray, start: np.ndarray,
            length: np.ndarray, kind: np.ndarray, kinds: pa.Array) -> pa.RecordBatch:
    """Packs with the columns ``shared`` (key, block) and ``pred``; span i is in pack ``row[i]``, rows ascending."""
    n = len(pred)
    types_at, own, local = kinds_of_rows(row, kind, n, len(kinds))
    wide = bool(length.min() < 0 or length.max() >= 1 << 16 or local.max() >= 1 << 16)
    spans = np.empty(len(row), WIDE if wide else SMALL)
    spans["start"], spans["length"], spans["type"] = start, length, local
    ends = np.searchsorted(row, np.arange(n + 1)) * spans.dtype.itemsize
    types = pa.ListArray.from_arrays(pa.array(types_at, pa.int32()), kinds.take(pa.array(own)))
    data = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(spans.tobytes())])
    return pa.RecordBatch.from_arrays([*shared, pa.array(pred), types, pa.array(np.full(n, wide)), data], names)


def pack(pred: bool, names: list[str] | None = None):
    """Batches of (key columns..., start, end, type) -> key columns (``names``, or their own) and ``PACK``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            *keys, start, end, kind = batch.columns
            start, end = (x.to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for x in (start, end))
            block = start >> BLOCK_BITS
            heads = _heads([*keys, pa.array(block)], len(block))
            first = pa.array(np.flatnonzero(heads))
            kind = kind if pa.types.is_dictionary(kind.type) and not kind.null_count else passes.plain(kind).dictionary_encode(null_encoding="encode")
            yield _packed([*(k.take(first) for k in keys), pa.array(block).take(first)],
                          [*(names or batch.schema.names[:-3]), "block", "pred", "types", "wide", "data"],
                          np.full(len(first), pred), np.cumsum(heads) - 1, start - (block << BLOCK_BITS), end - start,
                          kind.indices.to_numpy(zero_copy_only=False).astype(np.int64), kind.dictionary)
    return run


def _spans(packs: pa.RecordBatch) -> tuple[list[np.ndarray], pa.Array]:
    """[pack, start, length, number of the type] of every span in the packs, and the types."""
    types, wide, data = (packs.column(packs.schema.get_field_index(c)) for c in ("types", "wide", "data"))
    wide = wide.to_numpy(zero_copy_only=False)
    named = types.flatten().dictionary_encode(null_encoding="encode")
    code = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    types_at = np.concatenate([[0], np.cumsum(types.value_lengths().to_numpy(zero_copy_only=False))])
    found = []
    for kind, rows in ((SMALL, np.flatnonzero(~wide)), (WIDE, np.flatnonzero(wide))):
        raw = data.take(pa.array(rows, pa.int64())).to_pylist()
        spans = np.frombuffer(b"".join(raw), kind)
        row = np.repeat(rows, [len(x) // kind.itemsize for x in raw]).astype(np.int64)
        found.append([row, spans["start"].astype(np.int64), spans["length"].astype(np.int64), code[types_at[row] + spans["type"]]])
    return [np.concatenate(x) for x in zip(*found)], named.dictionary


def _counted(packs: pa.RecordBatch, heads: np.ndarray) -> pa.RecordBatch:
    (row, start, length, kind), _ = _spans(packs)
    pred = packs.column(packs.schema.get_field_index("pred")).to_numpy(zero_copy_only=False)
    spans = np.sort(_one_number([np.cumsum(heads)[row], start, length, kind]) * 2 + pred[row])
    distinct = spans[np.append(True, spans[1:] != spans[:-1])]
    n_pred = int((distinct & 1).sum())
    tp = int((distinct[1:] - distinct[:-1] == (~distinct[:-1] & 1)).sum())      # a gold span, then its equal
    return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (len(distinct) - n_pred, n_pred, tp)], ["n_gold", "n_pred", "tp"])


def _thinned(packs: pa.RecordBatch, n_shared: int) -> pa.RecordBatch:
    """The packs of one key and block as one for each side, without repeated spans."""
    if packs.num_rows <= 2:
        return packs
    (row, start, length, kind), kinds = _spans(packs)
    side = packs.column(packs.schema.get_field_index("pred")).to_numpy(zero_copy_only=False)[row].astype(np.int64)
    _, one = np.unique(_one_number([side, start, length, kind]), return_index=True)
    sides, row = np.unique(side[one], return_inverse=True)
    return _packed([packs.column(i).take(pa.array([0] * len(sides))) for i in range(n_shared)], packs.schema.names,
                   sides.astype(bool), row, start[one], length[one], kind[one], kinds)


def agreement(n_keys: int):
    """Packs in order of key and block -> distinct gold and predicted spans and those on both sides, a row a batch."""
    n_shared = n_keys + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for part in (p for b in batches for p in portions(b, text_sizes(b.column(b.schema.get_field_index("data"))), BYTES)):
            packs = part if held is None else pa.concat_batches([held, part])
            heads = _heads(packs.columns[:n_shared], packs.num_rows)
            last = int(np.flatnonzero(heads)[-1])
            if last:
                yield _counted(packs.slice(0, last), heads[:last])
            held = _thinned(packs.slice(last), n_shared)
        if held is not None:
            yield _counted(held, np.arange(held.num_rows) == 0)
    return run
