"""Files whose records span separators, read by many tasks: JSON arrays and CSV with quoted newlines.

Spark's text source cuts a file into splits at a separator (``}`` or the line end), on any file system. Whether such a
piece ends a record depends on all text before it: on being inside quotes, and for JSON on the depth of open braces.
So the file is scanned for both states it may be in at a split's start; a split's outcome is then a row of a few
numbers, and the splits of a file are put in order to find the state each really starts in. With it every task puts its
own records together. Only a record that crosses splits is shuffled. The text is scanned once for the states, and again
for the records inside a split, for crossing records and for plain splits, each where the states show any; it is never
shuffled as a whole, and memory is bounded by a batch and one record. A split of CSV in which every line is a record is
plain: its lines are taken as they are and don't go through Python again.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUMMARY = ("file string, start long, quoted_0 boolean, depth_0 long, low_0 long, "
           "quoted_1 boolean, depth_1 long, low_1 long, tail string, spans boolean, head string, heads long")
STATE = "file string, start long, quoted boolean, depth long, owner long, crosses boolean, plain boolean, head string"
HEAD = 1 << 16               # characters of a header that a split's state holds; a split with a longer one is not plain
PART = "file string, owner long, place long, start long, text string, whole boolean"
_PART_ARROW = pa.schema([("file", pa.string()), ("owner", pa.int64()), ("place", pa.int64()), ("start", pa.int64()),
                         ("text", pa.string()), ("whole", pa.bool_())])

#: Piece -> for a start outside and inside quotes: (inside quotes at its end, change of depth).
Walk = Callable[[str], tuple[tuple[bool, int], tuple[bool, int]]]

_ESCAPE = re.compile(r"\\.", re.S)
_ARRAY_END = re.compile(r"\s*\uFEFF?\s*\[?\s*\]\s*")


def walk_json(piece: str) -> tuple[tuple[bool, int], tuple[bool, int]]:
    """A piece that a ``}`` ends; escapes occur inside strings only, so none crosses a piece of valid JSON."""
    parts = (_ESCAPE.sub("", piece) if "\\" in piece else piece).split('"')
    odd = len(parts) % 2 == 0
    opens = [sum(p.count("{") for p in parts[k::2]) for k in (0, 1)]
    return (odd, opens[0] - (not odd)), (not odd, opens[1] - odd)


def csv_walk(sep: str = ",") -> Walk:
    """Lines of CSV: a quote opens a value only at a field's start, a doubled quote inside is text."""
    def end(line: str, quoted: bool) -> bool:
        at = 0
        while True:
            if not quoted and line.startswith('"', at):
                quoted, at = True, at + 1
            if quoted:
                close = line.find('"', at)
                while close >= 0 and line.startswith('"', close + 1):
                    close = line.find('"', close + 2)
                if close < 0:
                    return True
                quoted, at = False, close + 1
            field = line.find(sep, at)
            if field < 0:
                return False
            at = field + len(sep)

    def walk(line: str):
        if '"' not in line:
            return (False, 0), (True, 0)
        return (end(line, False), 0), (end(line, True), 0)
    return walk


def _quote_marks(lines: pa.StringArray, sep: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines with a quote, lines that are inside quotes at their end when they start outside, lines to be walked for that).

    From outside, the quotes of a line open and close in turn if every opening one is at a field's start or doubles the
    one before it. Other lines have to be walked.
    """
    offsets = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset:lines.offset + len(lines) + 1]
    raw = np.frombuffer(lines.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    bounds = offsets - offsets[0]
    at = np.flatnonzero(raw == ord('"'))
    line = np.searchsorted(bounds, at, side="right") - 1
    n = np.bincount(line, minlength=len(lines))
    opens = (np.arange(len(at)) - (np.cumsum(n) - n)[line]) % 2 == 0
    before = raw[at - 1] if len(raw) else raw
    regular = (at == bounds[line]) | (before == ord(sep)) | (before == ord('"'))
    walked = np.zeros(len(lines), bool)
    walked[line[opens & ~regular]] = True
    return n > 0, n % 2 == 1, walked


def _line_ends(lines: pa.StringArray, walk: Walk, sep: str) -> Callable[[bool], np.ndarray]:
    """Start state of some lines of CSV -> whether each line ends inside quotes."""
    marked, opened, walked = _quote_marks(lines, sep)
    for i in np.flatnonzero(walked):
        opened[i] = walk(lines[i].as_py())[0][0]
    marked_at, opened_at = np.flatnonzero(marked), np.flatnonzero(opened)

    def ends(quoted: bool) -> np.ndarray:
        out, i = np.zeros(len(lines), bool), 0
        while i < len(lines):
            where = marked_at if quoted else opened_at
            k = np.searchsorted(where, i)
            to = where[k] if k < len(where) else len(lines)
            out[i:to] = quoted
            if to < len(lines):
                quoted = walk(lines[int(to)].as_py())[1][0] if quoted else True
                out[to] = quoted
            i = to + 1
        return out
    return ends


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """A batch cut where the split changes."""
    start, file = (np.asarray(c) for c in (batch["start"], batch["file"].dictionary_encode().indices))
    cuts = np.flatnonzero((np.diff(start) != 0) | (np.diff(file) != 0)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(start)]):
        if b > a:
            yield (batch["file"][a].as_py(), int(start[a])), batch.slice(a, b - a)


def _csv_summaries(walk: Walk, sep: str):
    """:func:`_summaries` of CSV lines, a batch at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for batch in batches:
            for split, part in _runs(batch):
                if split != at:
                    at = split
                    head = part["value"][0].as_py() if at[1] == 0 else None
                    rows.append([*at, False, 0, None, True, 0, None, None, False, head if head and len(head) <= HEAD else None, 0])
                row, ends = rows[-1], _line_ends(part["value"], walk, sep)
                for k in (2, 5):
                    inside = ends(row[k])
                    row[k] = bool(inside[-1])
                    row[k + 2] = row[k + 2] if inside.all() else 0
                    if k == 2:
                        row[9] = row[9] or bool(inside.any())
                if row[10] is not None:
                    row[11] += pc.sum(pc.equal(part["value"], row[10])).as_py()
                tail = part["value"][-1].as_py()
                row[8] = tail if len(tail) <= 64 else "..."
        if rows:
            yield _summary_rows(rows)
    return run


def _summary_rows(rows: list[list]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    names, types = zip(*(c.split() for c in SUMMARY.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, k in zip(zip(*rows), types)], names=list(names))


def _csv_parts(walk: Walk, sep: str):
    """:func:`_parts` of CSV lines, a batch at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def left():
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(
                (at[0], key, place, at[1], "\n".join(held) + "\n", False), _PART_ARROW)], schema=_PART_ARROW)

        at, held = None, []
        for batch in batches:
            for split, part in _runs(batch):
                if split != at:
                    if held:
                        yield left()
                    at, held, place = split, [], 0
                    inside, key = part["quoted"][0].as_py(), part["owner"][0].as_py()
                    whole = not inside
                lines = part["value"]
                quoted = _line_ends(lines, walk, sep)(inside)
                inside = bool(quoted[-1])
                last = np.flatnonzero(~quoted)
                done = int(last[-1]) + 1 if len(last) else 0
                if done:
                    bounds = pa.array(np.concatenate([[0], last + 1]), pa.int32())
                    texts = pc.binary_join(pa.ListArray.from_arrays(bounds, lines.slice(0, done)), "\n")
                    if held:
                        first = "\n".join([*held, texts[0].as_py()])
                        texts = pa.concat_arrays([pa.array([first], texts.type), texts.slice(1)])
                    n = len(texts)
                    keys, wholes = np.full(n, split[1]), np.ones(n, bool)
                    keys[0], wholes[0] = key, whole
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(pa.scalar(split[0], pa.string()), n), pa.array(keys, pa.int64()), pa.array(np.arange(place, place + n), pa.int64()),
                         pa.repeat(pa.scalar(split[1], pa.int64()), n),
                         pc.binary_join_element_wise(texts, "", "\n"), pa.array(wholes)], schema=_PART_ARROW)
                    held, place, key, whole = [], place + n, split[1], True
                held += lines.slice(done).to_pylist()
        if held:
            yield left()
    return run


def _pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    return (spark.read.option("lineSep", separator).text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                    "value"))


def _summaries(walk: Walk):
    """One row per split: state at its end and lowest depth at a piece's end outside quotes, for both start states."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row():
            return [*at, *ends[0], *ends[1], tail, True, None, 0]

        at, rows = None, []
        for batch in batches:
            for file, start, value in zip(*[c.to_pylist() for c in batch.columns]):
                if (file, start) != at:
                    if at is not None:
                        rows.append(row())
                    at, ends = (file, start), [[False, 0, None], [True, 0, None]]
                moves = walk(value)
                for e in ends:
                    e[0], change = moves[e[0]]
                    e[1] += change
                    if not e[0]:
                        e[2] = e[1] if e[2] is None else min(e[2], e[1])
                tail = value if len(value) <= 64 else "..."
        if at is not None:
            rows.append(row())
        if rows:
            yield _summary_rows(rows)
    return run


def _states(array: bool):
    """The splits of one file in order: the state each starts in, and the split in which the record open there began.

    For CSV also whether a record crosses an end of the split, and whether every line is a record (``plain``; the first
    split's header must be the only line like it, to be known again by ``head``).
    """
    def run(splits: pd.DataFrame) -> pd.DataFrame:
        quoted, depth, owner, out = False, 0, None, []
        for s in splits.sort_values("start").itertuples():
            inside = quoted or depth > 0
            starts = (s.file, s.start, quoted, depth, owner if inside else s.start)
            plain = not (array or inside or s.spans or (s.start == 0 and s.heads != 1))
            low = s.low_1 if quoted else s.low_0
            ends = not pd.isna(low) and depth + low <= 0
            quoted, change = (s.quoted_1, s.depth_1) if quoted else (s.quoted_0, s.depth_0)
            depth = max(depth + int(change), 0)
            if ends or not inside:
                owner = s.start
            out.append((*starts, array or inside or quoted, plain, s.head if plain and s.start == 0 else None))
        if quoted or depth > 0 or (array and not _ARRAY_END.fullmatch(s.tail)):
            raise ValueError(f"{s.file} ends inside a record" + (" or is no JSON array" if array else ""))
        return pd.DataFrame(out, columns=[c.split()[0] for c in STATE.split(", ")])
    return run


def _parts(walk: Walk, separator: str):
    """Whole records of each split, and the parts of those that cross its ends."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            rows = []
            for file, start, quoted, depth, owner, value in zip(*[c.to_pylist() for c in batch.columns]):
                if (file, start) != at:
                    if held:
                        rows.append((at[0], key, place, at[1], separator.join(held) + separator, False))
                    at, held, place = (file, start), [], 0
                    inside, level, key, whole = quoted, depth, owner, not (quoted or depth > 0)
                held.append(value)
                inside, change = walk(value)[inside]
                level += change
                if not inside and level <= 0:
                    rows.append((file, key, place, start, separator.join(held) + separator, whole))
                    held, place, level, key, whole = [], place + 1, 0, start, True
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _PART_ARROW)],
                                                 schema=_PART_ARROW)
        if held:
            row = (at[0], key, place, at[1], separator.join(held) + separator, False)
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _PART_ARROW)],
                                             schema=_PART_ARROW)
    return run


def read_spanning(spark: SparkSession, path: str, separator: str, summaries, whole_parts, array: bool = False) -> DataFrame:
    """One row per record: file, owner (byte at which its split starts), place in that split, text with its separator.

    Lines of a plain split all have place 1, and its header is left out.

    ``summaries`` and ``whole_parts`` are the passes over the pieces, by piece or by batch of lines.

    The broadcast table has one short row per split of the scan, of which the driver keeps as many itself to plan it.
    """
    pieces = _pieces(spark, path, separator)
    states = (pieces.mapInArrow(summaries, SUMMARY)
              .groupBy("file").applyInPandas(_states(array), STATE))

    def of(which):
        return pieces.join(F.broadcast(states.where(which)), ["file", "start"])

    def parts(which):
        return of(which).select("file", "start", "quoted", "depth", "owner", "value").mapInArrow(whole_parts, PART)
    crossing = (parts("crosses").where(~F.col("whole")).groupBy("file", "owner")
                .agg(F.min_by("place", "start").alias("place"),
                     F.array_sort(F.collect_list(F.struct("start", "text"))).alias("p"))
                .select("file", "owner", "place", F.array_join("p.text", "").alias("text")))
    records = parts("NOT plain").where("whole").select("file", "owner", "place", "text").unionByName(crossing)
    if array:
        return records
    lines = of("plain").where("start <> 0 OR value <> head")
    return records.unionByName(lines.select("file", F.col("start").alias("owner"), F.lit(1).cast("long").alias("place"),
                                            F.concat("value", F.lit(separator)).alias("text")))


def read_json_array(spark: SparkSession, path: str, schema) -> DataFrame:
    """The objects of files that each hold one JSON array, a column per field; an object that doesn't parse is nulls.

    An array's elements must be objects; anything else between them, or a file that doesn't end its array, is an error.
    """
    units = read_spanning(spark, path, "}", _summaries(walk_json), _parts(walk_json, "}"), array=True)
    at = F.locate("{", F.col("text"))
    before = F.when(at > 0, F.substring_index("text", "{", 1)).otherwise(F.regexp_replace("text", r"\}$", ""))
    units = units.select(F.when(before.rlike(r"^[\s,\[\]\uFEFF]*$"), F.expr("substr(text, locate('{', text))"))
                         .otherwise(F.raise_error(F.concat(F.lit("no JSON object: "), before))).alias("text"),
                         at.alias("at")).where("at > 0")
    return units.select(F.from_json("text", schema).alias("r")).select("r.*")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headered CSV, quoted newlines allowed, every column text; equal to Spark's ``multiLine`` reader, in many tasks.

    Each file's first record is its header; the columns are named by the header that Spark's reader finds. Empty lines are
    skipped; a file that ends inside quotes is an error.
    """
    names = spark.read.options(header=True, multiLine=True, escape='"').csv(path).columns
    units = read_spanning(spark, path, "\n", _csv_summaries(csv_walk(), ","), _csv_parts(csv_walk(), ","))
    text = F.expr(r"left(text, length(text) - if(endswith(text, '\r\n'), 2, 1))")          # every text ends with a newline
    units = units.where(~((F.col("owner") == 0) & (F.col("place") == 0))).select(text.alias("text")).where("text <> ''")
    columns = ", ".join(f"`{name.replace('`', '``')}` string" for name in names)
    # inlined, not selected: what is asked of a column later is never asked of a second parse of its record
    return units.select(F.inline(F.array(F.from_csv("text", columns, {"multiLine": "true", "escape": '"'}))))
