"""Islands of BIO tags in Arrow batches: whole batches of sentences at a time, no loop over tokens.

An island starts wherever a tag does not continue the one before it (I-X after B-X or I-X of its sentence); ``strict``
counts islands opened by ``B-`` as entities, ``lenient`` those opened by ``I-`` as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .passes import made, plain

TOKENS = 1 << 20             # tokens worked on at a time; a longer sentence alone
CELLS = 1 << 22              # rows times kinds that are marked in one array
SPAN = np.dtype([("start", "<i4"), ("end", "<i4"), ("type", "<i4")])
FOUND = "struct<types array<string>, spans binary>"


def check_mode(mode: str) -> None:
    if mode not in ("strict", "lenient"):
        raise ValueError(f"mode must be strict or lenient, not {mode!r}")


def portions(batch: pa.RecordBatch | pa.Array, lengths: np.ndarray, tokens: int = TOKENS) -> Iterator[pa.RecordBatch | pa.Array]:
    """The batch (or array) in slices of rows that hold about ``tokens`` tokens."""
    a, until = 0, np.cumsum(lengths)
    while a < len(lengths):
        b = max(a + 1, int(np.searchsorted(until, tokens + (until[a - 1] if a else 0), side="right")))
        yield batch.slice(a, b - a)
        a = b


def lengths(column: pa.Array) -> np.ndarray:
    """Tokens of each sentence; of a null one none."""
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def bounds(n: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(n)])


def characters(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the characters of all texts as strings over the texts' own bytes, characters of each text); null: none."""
    n_bytes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    at = np.flatnonzero((raw & 0xC0) != 0x80).astype(np.int32)
    ends = np.append(at, len(raw)).astype(np.int32)
    chars = pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(raw))
    return chars, np.diff(np.searchsorted(at, bounds(n_bytes)))


def code_points(chs: pa.Array) -> np.ndarray:
    """The code points of what :func:`characters` gives, all texts' at once."""
    return np.frombuffer(str(memoryview(chs.buffers()[2] or b""), "utf-8").encode("utf-32-le"), "<u4").astype(np.int64)


def as_lists(values: pa.Array, n: np.ndarray, valid: pa.Array) -> pa.Array:
    """Values that follow one another as an array a row, null where not ``valid``."""
    return pa.ListArray.from_arrays(pa.array(bounds(n), pa.int32()), values, mask=pc.invert(valid))


def tags_by_first_byte(table: np.ndarray, names: list[str], ahead: bool = False):
    """Texts -> the tag of each character by its first byte, or the tags one character ahead (``names[0]`` at the end)."""
    def run(texts: pa.Array) -> pa.Array:
        found = [plain(coded_tags(part, table, names, ahead)) for part in portions(texts, text_sizes(texts))]
        return pa.concat_arrays(found) if found else pa.array([], pa.list_(pa.string()))
    return run


def text_sizes(texts: pa.Array) -> np.ndarray:
    """Bytes of each text; of a null one none."""
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def coded_tags(texts: pa.Array, table: np.ndarray, names: list[str], ahead: bool) -> pa.Array:
    """What :func:`tags_by_first_byte` gives for some texts, with the tags as numbers in ``names``."""
    chs, n = characters(texts)
    codes = table[np.frombuffer(chs.buffers()[2] or b"", np.uint8)[np.frombuffer(chs.buffers()[1], np.int32)[:len(chs)]]]
    if ahead:
        codes = np.append(codes[1:], codes.dtype.type(0))[:len(codes)]
        codes[bounds(n)[1:][n > 0] - 1] = 0
    return as_lists(pa.DictionaryArray.from_arrays(pa.array(codes), pa.array(names)), n, texts.is_valid())


def tagged_texts(source: DataFrame, text: str, table: np.ndarray, names: list[str], **ahead: bool) -> DataFrame:
    """``source`` with the tags of its texts by each character's first byte: a column for each of ``ahead``."""
    def make(wanted):
        own = [c for c in wanted if c not in ahead]
        own = own if text in own else [*own, text]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in portions(batch, text_sizes(batch.column(own.index(text)))):
                    texts = part.column(own.index(text))
                    yield pa.RecordBatch.from_arrays([coded_tags(texts, table, names, ahead[c]) if c in ahead else part.column(own.index(c))
                                                      for c in wanted], list(wanted))
        return source.select(*own), run
    return made(StructType([*source.schema.fields, *(StructField(c, ArrayType(StringType())) for c in ahead)]), make)


class TagCodes:
    """Tags as numbers: of each, whether it opens with ``B-`` (1), ``I-`` (2) or neither (0), and its type."""

    def __init__(self, names: list[str | None]):
        self.kind = np.array([0 if t is None else {"B-": 1, "I-": 2}.get(t[:2], 0) for t in names], np.int8)
        types = ["" if t is None else t[2:] for t in names]
        self.types = sorted(set(types))
        at = {t: i for i, t in enumerate(self.types)}
        self.type = np.array([at[t] for t in types], np.int32)

    @classmethod
    def of(cls, *values: pa.Array) -> tuple[TagCodes, list[np.ndarray]]:
        if all(pa.types.is_dictionary(v.type) for v in values):         # a pass's own tags: few names, each known once
            names, codes = [], []
            for v in values:
                codes.append(pc.fill_null(v.indices.cast(pa.int32()), len(v.dictionary)).to_numpy(zero_copy_only=False) + len(names))
                names += [*v.dictionary.to_pylist(), None]
            return cls(names), codes
        coded = pa.concat_arrays([v.dictionary_decode() if pa.types.is_dictionary(v.type) else v for v in values]).dictionary_encode()
        names = coded.dictionary.to_pylist()
        codes = pc.fill_null(coded.indices, len(names)).to_numpy(zero_copy_only=False)
        return cls([*names, None]), np.split(codes, np.cumsum([len(v) for v in values])[:-1])


@dataclass
class Entities:
    """Entities of some sentences: row, first and last token in it, number of their type."""
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    type: np.ndarray


def entities(codes: np.ndarray, n: np.ndarray, tags: TagCodes, mode: str) -> Entities:
    """The entities of sentences of ``n`` tokens each, whose tags follow one another in ``codes``."""
    kind, kinds, first = tags.kind[codes], tags.type[codes], bounds(n)
    goes_on = np.zeros(len(codes), bool)
    goes_on[1:] = (kind[1:] == 2) & (kind[:-1] > 0) & (kinds[1:] == kinds[:-1])
    goes_on[first[:-1][n > 0]] = False
    start = np.flatnonzero(~goes_on)
    end = np.append(start[1:], len(codes))[:len(start)] - 1
    kept = kind[start] == 1 if mode == "strict" else kind[start] > 0
    start, end = start[kept], end[kept]
    row = np.repeat(np.arange(len(n)), n)[start]
    return Entities(row, start - first[row], end - first[row], kinds[start])


def joined(tokens: pa.Array, found: Entities, joiner: str) -> pa.Array:
    """The tokens of each entity joined, without null ones; null where its sentence's tokens are null."""
    n, values = lengths(tokens), tokens.flatten()
    first = bounds(n)
    a = first[found.row] + np.minimum(found.start, n[found.row])
    b = first[found.row] + np.minimum(found.end + 1, n[found.row])
    if values.null_count:
        solid = bounds(values.is_valid().to_numpy(zero_copy_only=False).astype(np.int64))
        a, b, values = solid[a], solid[b], values.drop_null()
    ends = pa.array(np.append(np.stack([a, b], axis=1).ravel(), len(values)), pa.int32())
    texts = pc.binary_join(pa.ListArray.from_arrays(ends, values), joiner).take(pa.array(np.arange(0, 2 * len(a), 2)))
    if tokens.null_count:
        texts = pc.if_else(tokens.is_valid().take(pa.array(found.row)), texts, pa.scalar(None, pa.string()))
    return texts


def entity_rows(keys: list[pa.Array], names: list[str], found: Entities, tags: TagCodes, texts: pa.Array) -> pa.RecordBatch:
    row = pa.array(found.row)
    kinds = pa.array(tags.types, pa.string()).take(pa.array(found.type))
    return pa.RecordBatch.from_arrays([*(k.take(row) for k in keys), pa.array(found.start, pa.int32()), pa.array(found.end, pa.int32()), kinds, texts],
                                      [*names, "start", "end", "type", "text"])


def kinds_of_rows(row: np.ndarray, kind: np.ndarray, n_rows: int, n_kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds of each row's kinds, those kinds row by row, each item's kind by its number in its row)."""
    n_kinds = max(n_kinds, 1)
    cell = row * np.int64(n_kinds) + kind
    if n_rows * n_kinds <= CELLS:
        seen = np.zeros(n_rows * n_kinds, bool)
        seen[cell] = True
        pairs, number = np.flatnonzero(seen), (np.cumsum(seen) - 1)[cell]
    else:
        pairs, number = np.unique(cell, return_inverse=True)
    at = np.searchsorted(pairs, np.arange(n_rows + 1, dtype=np.int64) * n_kinds)
    return at, pairs % n_kinds, number - at[row]


def find(mode: str):
    """Tags of sentences -> ``FOUND``: the names of a sentence's types, and its entities as ``SPAN`` bytes."""
    def run(tagged: pa.Array) -> pa.Array:
        rows = []
        for part in portions(tagged, lengths(tagged)):
            tags, (codes,) = TagCodes.of(part.flatten())
            e = entities(codes, lengths(part), tags, mode)
            at, kinds, number = kinds_of_rows(e.row, e.type, len(part), len(tags.types))
            spans = np.empty(len(e.row), SPAN)
            spans["start"], spans["end"], spans["type"] = e.start, e.end, number
            ends = (np.searchsorted(e.row, np.arange(len(part) + 1)) * SPAN.itemsize).astype(np.int32)
            rows.append(pa.StructArray.from_arrays(
                [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(tags.types, pa.string()).take(pa.array(kinds, pa.int64()))),
                 pa.BinaryArray.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(ends), pa.py_buffer(spans.tobytes())])], ["types", "spans"]))
        return pa.concat_arrays(rows) if rows else pa.array([], pa.struct([("types", pa.list_(pa.string())), ("spans", pa.binary())]))
    return run


def rows(joiner: str):
    """Batches of (keys..., tokens, ``FOUND``) -> one row per entity; a text stands for its characters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column(batch.num_columns - 2)
            size = lengths(tokens) if pa.types.is_list(tokens.type) else pc.fill_null(pc.binary_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for part in portions(batch, size):
                *keys, tokens, found = part.columns
                if not pa.types.is_list(tokens.type):
                    chs, n = characters(tokens)
                    tokens = as_lists(chs, n, tokens.is_valid())
                types, raw = found.flatten()
                raw = raw.to_pylist()
                spans = np.frombuffer(b"".join(raw), SPAN)
                row = np.repeat(np.arange(len(raw)), [len(x) // SPAN.itemsize for x in raw])
                e = Entities(row, spans["start"].astype(np.int64), spans["end"].astype(np.int64), bounds(lengths(types))[row] + spans["type"])
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(k.take(at) for k in keys), pa.array(e.start, pa.int32()), pa.array(e.end, pa.int32()), types.flatten().take(pa.array(e.type, pa.int64())), joined(tokens, e, joiner)],
                    [*part.schema.names[:-2], "start", "end", "type", "text"])
    return run


def of_tags(mode: str, n_keys: int, wanted: list[str], joiner: str):
    """Batches of (keys..., tags[, tokens where the text is wanted]) -> the wanted of keys (by number), start, end, type, text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, lengths(batch.column(n_keys))):
                tags, (codes,) = TagCodes.of(part.column(n_keys).flatten())
                e = entities(codes, lengths(part.column(n_keys)), tags, mode)
                row, cols = pa.array(e.row), []
                for c in wanted:
                    if isinstance(c, int):
                        cols.append(part.column(c).take(row))
                    elif c == "text":
                        tokens = part.column(n_keys + 1)
                        if not pa.types.is_list(tokens.type):
                            chs, n = characters(tokens)
                            tokens = as_lists(chs, n, tokens.is_valid())
                        cols.append(joined(plain(tokens), e, joiner))
                    elif c == "type":
                        cols.append(pa.DictionaryArray.from_arrays(pa.array(e.type), pa.array(tags.types, pa.string())))
                    else:
                        cols.append(pa.array(e.start if c == "start" else e.end, pa.int32()))
                yield pa.RecordBatch.from_arrays(cols, [str(c) for c in wanted])
    return run


def counts(mode: str):
    """Batches of (gold tags, predicted tags) -> entities of either side and those that agree, a row a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = lengths(batch.column(0)) + lengths(batch.column(1))
            n_gold = n_pred = tp = 0
            for part in portions(batch, both):
                gold, pred = part.columns
                tags, codes = TagCodes.of(gold.flatten(), pred.flatten())
                g, p = (entities(c, lengths(x), tags, mode) for c, x in zip(codes, (gold, pred)))
                place = bounds(np.maximum(*map(lengths, (gold, pred))))                # one entity a place on either side
                known = np.full(place[-1] + 1, -1)
                known[place[g.row] + g.start] = g.end * len(tags.types) + g.type
                tp += int((known[place[p.row] + p.start] == p.end * len(tags.types) + p.type).sum())
                n_gold, n_pred = n_gold + len(g.row), n_pred + len(p.row)
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (n_gold, n_pred, tp)], ["n_gold", "n_pred", "tp"])
    return run
