"""Python passes over Arrow batches that follow one another in one worker.

A DataFrame that :func:`made` gives is a ``mapInArrow`` over its source that remembers how it is made, for any choice of
its columns. The next pass takes its batches from it in the worker (:func:`taken`), of the columns it reads only; between
the two no row goes through the JVM, and a column that nothing reads is not made. To everyone else it is a plain
DataFrame. Inside a pass, arrays of strings may be dictionary-encoded; they are written out where a pass ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

#: Names of columns -> the source and the pass over it that gives batches of these columns, in this order.
Make = Callable[[tuple[str, ...]], tuple[DataFrame, Run]]


def plain(column: pa.Array) -> pa.Array:
    """An array column (or array of arrays) without dictionaries."""
    if pa.types.is_dictionary(column.type):
        return column.dictionary_decode()
    if pa.types.is_list(column.type) and pa.types.is_dictionary(column.type.value_type):
        values = column.values.dictionary_decode()
        lists = pa.ListArray.from_arrays(column.offsets, values, mask=pc.is_null(column) if column.null_count and not column.offset else None)
        return lists if not column.offset or not column.null_count else pc.if_else(column.is_valid(), lists, pa.scalar(None, lists.type))
    return column


def made(schema: StructType, make: Make) -> DataFrame:
    names = tuple(schema.names)
    source, run = make(names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(batches):
            yield pa.RecordBatch.from_arrays([plain(c) for c in b.columns], list(names))
    out = source.mapInArrow(whole, schema)
    out._made = make
    return out


def is_made(df: DataFrame) -> bool:
    return "_made" in df.__dict__


def then(before: Run, run: Run) -> Run:
    """Both passes as one."""
    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(before(batches))
    return both


def taken(df: DataFrame, names: Sequence[str]) -> tuple[DataFrame, Run]:
    """The source of the columns ``names`` of ``df``, and the pass that gives batches of them (none where ``df`` is no pass's)."""
    if is_made(df):
        return df._made(tuple(names))
    return df.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(names))), iter


def columns(df: DataFrame, **names: str) -> DataFrame:
    """``df`` with the columns ``names`` (new name = name in ``df``), still a pass where ``df`` is one."""
    if not is_made(df):
        return df.select(*(F.col(c).alias(new) for new, c in names.items()))
    schema = df.select(*(F.col(c).alias(new) for new, c in names.items())).schema
    return made(schema, lambda wanted: taken(df, [names[c] for c in wanted]))
