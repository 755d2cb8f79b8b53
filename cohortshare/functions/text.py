"""String column expressions (JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Characters that Python's str.strip() removes (str.isspace), built from the rule.
WHITESPACE_CHARS = sorted(ch for ch in map(chr, range(0x110000)) if ch.isspace())


def is_space_char(c) -> Column:
    """TRUE when a one-character string is white space (a set lookup, no regex)."""
    return col_of(c).isin(WHITESPACE_CHARS)


def ustrip(c) -> Column:
    """Strip Unicode white space at both ends (Spark ``trim`` removes only spaces)."""
    return F.regexp_replace(col_of(c), r"(?U)^\s+|\s+$", "")


def is_blank(c) -> Column:
    """TRUE for a string made only of white space (incl. the empty string)."""
    return col_of(c).rlike(r"(?U)^\s*$")


def chars(c) -> Column:
    """Array of the code points of a string; the empty string gives ``[]``."""
    c = col_of(c)
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.split(c, ""))
