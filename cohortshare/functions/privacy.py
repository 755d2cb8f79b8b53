"""Generalisation and noise expressions for de-identification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_of, is_blank, ustrip

# Fixed values of the method: suppression marker and default parameters.
SUPPRESSED = "*"
AGE_BIN_WIDTH = 12
K = 5
DP_EPSILON = 1.0


def generalise_location(c) -> Column:
    """City level: the text before the first ASCII comma, stripped.

    NULL or all-white-space text is suppressed to ``*``; ``",x"`` gives ``""``.
    """
    c = col_of(c)
    return (F.when(c.isNull() | is_blank(c), F.lit(SUPPRESSED))
            .otherwise(ustrip(F.split_part(c, F.lit(","), F.lit(1)))))


def generalise_date(c) -> Column:
    """Year-month: the first 7 characters; NULL or shorter text is suppressed."""
    c = col_of(c)
    return F.when(F.length(c) >= 7, F.substring(c, 1, 7)).otherwise(F.lit(SUPPRESSED))


def generalise_age(c, width: int = AGE_BIN_WIDTH) -> Column:
    """Interval label ``[lo,lo+w)`` with ``lo = floor(v / w) * w``; NULL/NaN -> ``*``."""
    v = col_of(c).cast("double")
    lo = F.floor(v / F.lit(float(width))) * F.lit(width)
    label = F.concat(F.lit("["), lo.cast("string"), F.lit(","),
                     (lo + F.lit(width)).cast("string"), F.lit(")"))
    return F.when(v.isNull() | F.isnan(v), F.lit(SUPPRESSED)).otherwise(label)


def keyed_uniform(key, salt: str, name: str) -> Column:
    """A uniform draw in (-1/2, 1/2) fixed by (salt, key, name).

    First 32 bits of ``md5(salt|key|name)``; independent of partitioning, so a
    re-run (or a retried task) draws the same noise.
    """
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(salt), col_of(key).cast("string"),
                                              F.lit(name))), 1, 8), 16, 10).cast("double")
    return (h + F.lit(0.5)) / F.lit(4294967296.0) - F.lit(0.5)


def laplace_from_uniform(u: Column, scale) -> Column:
    """Inverse CDF of Laplace(0, b) at ``u`` in (-1/2, 1/2)."""
    b = scale if isinstance(scale, Column) else F.lit(float(scale))
    return -b * F.signum(u) * F.log(F.greatest(F.lit(1.0) - F.lit(2.0) * F.abs(u), F.lit(1e-300)))
