"""De-identification: generalise, k-anonymise, add Laplace noise, report.

Plan shape at scale: the quasi-identifiers are generalised in a projection; one
hash aggregate on the generalised quasi-identifiers (with map-side partial
aggregation, so a class holding a third of all rows is combined before the
shuffle) yields every class size plus the per-class minima and maxima that the
noise scale and the report need.  The rows are then kept with a left-semi join
against the classes of size >= k; AQE turns that join into a broadcast when the
class table is small at run time, and splits skewed partitions otherwise.  No
window is partitioned by the quasi-identifiers, so a hot class never lands in
one task.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from zlib import crc32

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.privacy import (AGE_BIN_WIDTH, DP_EPSILON, K, generalise_age, generalise_date,
                                 generalise_location, keyed_uniform, laplace_from_uniform)

# The quasi-identifiers after generalisation and the noised columns.
QI = ("age_months_gen", "location", "diagnosis_date")
NUMERIC_COLS = ("lab_value",)


def _nan_to_null(c: str) -> Column:
    x = F.col(c)
    return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x.cast("double"))


def apply_generalisation(df: DataFrame, age: str = "age_months", location: str = "location",
                         date: str = "diagnosis_date", width: int = AGE_BIN_WIDTH,
                         drop: tuple[str, ...] = ()) -> DataFrame:
    """Overwrite location and date, add ``<age>_gen``; every other column is kept.

    ``drop`` removes columns (e.g. the exact age or a free-text note) from the output.
    """
    cols = {}
    if location in df.columns:
        cols[location] = generalise_location(location)
    if date in df.columns:
        cols[date] = generalise_date(date)
    if age in df.columns:
        cols[f"{age}_gen"] = generalise_age(age, width)
    return df.withColumns(cols).drop(*drop)


def equivalence_classes(df: DataFrame, qi=QI, measures=()) -> DataFrame:
    """E1 at scale: one row per class with ``class_size`` and min/max of ``measures``."""
    aggs = [F.count(F.lit(1)).alias("class_size")]
    for m in measures:
        aggs += [F.min(m).alias(f"_min_{m}"), F.max(m).alias(f"_max_{m}")]
    return df.groupBy(*qi).agg(*aggs)


def with_class_size(df: DataFrame, qi=QI) -> DataFrame:
    """Attach the class size to each row (aggregate + equi-join, not a window)."""
    return df.join(equivalence_classes(df, qi), list(qi), "inner")


def enforce_k_anonymity(df: DataFrame, k: int = K, qi=QI) -> DataFrame:
    """Keep rows whose class has at least ``k`` rows; ``*`` is an ordinary value."""
    keep = equivalence_classes(df, qi).where(F.col("class_size") >= k).select(*qi)
    return df.join(keep, list(qi), "left_semi")


def value_range(df: DataFrame, cols=NUMERIC_COLS) -> dict[str, float | None]:
    """D3: max - min of the non-missing values (0 -> 1.0); None when absent/all missing."""
    present = [c for c in cols if c in df.columns]
    if not present:
        return {}
    row = df.agg(*[F.min(_nan_to_null(c)).alias(f"lo{i}") for i, c in enumerate(present)],
                 *[F.max(_nan_to_null(c)).alias(f"hi{i}") for i, c in enumerate(present)]).first()
    return {c: _sensitivity(row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(present)}


def _sensitivity(lo, hi):
    if lo is None or hi is None:
        return None
    return float(hi - lo) or 1.0


def column_seed(seed: int | None, column: str) -> int | None:
    """A seed of its own for every column, so that columns don't share draws."""
    return None if seed is None else (seed << 32) ^ crc32(column.encode())


def laplace_noise(df: DataFrame, cols=NUMERIC_COLS, epsilon: float = DP_EPSILON, *,
                  key: str | None = None, salt: str = "", seed: int | None = None,
                  sensitivity: dict[str, float | None] | None = None,
                  bounds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Value + Laplace(0, sensitivity / epsilon); missing stays missing.

    Sensitivity is the observed range of the column in ``df`` (as the reference
    does) unless given, or derived from user ``bounds`` (which also clip).
    With ``key`` the draw is a hash of (salt, key, column), the same on every run:
    the salt must be given and kept secret, or the noise could be taken off again,
    and ``key`` must be unique, as equal keys draw equal noise.  Without ``key`` each
    column has a ``rand`` of its own seed.
    """
    if key and not salt:
        raise ValueError("keyed noise without a salt can be undone by whoever has the key: give a secret salt")
    bounds = bounds or {}
    present = [c for c in cols if c in df.columns]
    if sensitivity is None:
        need = [c for c in present if c not in bounds]
        sensitivity = value_range(df, need) if need else {}
    out = df
    for c in present:
        x = _nan_to_null(c)
        if c in bounds:
            lo, hi = bounds[c]
            x = F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))
            sens = float(hi - lo) or 1.0
        else:
            sens = sensitivity.get(c)
            if sens is None:  # column entirely missing: left unchanged
                continue
        u, drawn = F.rand(column_seed(seed, c)) - F.lit(0.5), ()
        if key:                    # a column of its own: the hash is taken once, though the draw is read twice
            drawn = (f"_draw_{c}",)
            out, u = out.withColumn(drawn[0], keyed_uniform(key, salt, c)), F.col(drawn[0])
        noisy = x + laplace_from_uniform(u, sens / float(epsilon))
        out = out.withColumn(c, F.when(x.isNull(), x).otherwise(noisy)).drop(*drawn)
    return out


def information_loss(original: DataFrame, age: str = "age_months", width: int = AGE_BIN_WIDTH) -> DataFrame:
    """``min(width / (max-min of the original ages, 0 -> 1), 1) * 100``, rounded 2.

    No ages at all gives 0.0.  (The anonymised table plays no part, as in the reference.)
    """
    a = _nan_to_null(age)
    return original.agg(_loss_expr(F.min(a), F.max(a), width).alias("information_loss"))


def _loss_expr(lo: Column, hi: Column, width: int) -> Column:
    dom = F.coalesce(F.nullif(hi - lo, F.lit(0.0)), F.lit(1.0))
    return F.when(lo.isNull(), F.lit(0.0)).otherwise(
        F.round(F.least(F.lit(float(width)) / dom, F.lit(1.0)) * F.lit(100.0), 2))


def reidentification_risk(anonymised: DataFrame, qi=QI) -> DataFrame:
    """Mean over rows of 1/class size, in percent, rounded 4; empty -> 0.0.

    Each class contributes exactly 1 to the sum, so the mean is
    classes / rows: one aggregate over the class table, no window.
    """
    classes = equivalence_classes(anonymised, qi)
    return classes.agg(_risk_expr(F.count(F.lit(1)), F.sum("class_size")).alias("reid_risk"))


def _risk_expr(n_classes: Column, n_rows: Column) -> Column:
    return F.when(F.coalesce(n_rows, F.lit(0)) == 0, F.lit(0.0)).otherwise(
        F.round(F.lit(100.0) * n_classes / n_rows, 4))


@dataclass
class Deidentified:
    data: DataFrame      # anonymised rows
    report: DataFrame    # one row: records_in, records_out, classes_out, information_loss, reid_risk
    cached: tuple = ()

    def release(self) -> None:
        """Drop the persisted class table once the outputs are written."""
        for d in self.cached:
            d.unpersist()


def deidentify(df: DataFrame, *, k: int = K, epsilon: float = DP_EPSILON, width: int = AGE_BIN_WIDTH,
               age: str = "age_months", location: str = "location", date: str = "diagnosis_date",
               numeric_cols=NUMERIC_COLS, key: str | None = None, salt: str = "", seed: int | None = None,
               bounds: dict[str, tuple[float, float]] | None = None,
               drop: tuple[str, ...] = ()) -> Deidentified:
    """Generalise -> k-anonymise -> Laplace noise, with the privacy report.

    One aggregate on the quasi-identifiers serves suppression, the noise scale
    (ranges taken after suppression) and the report (loss on the input ages,
    risk on the output).  The class table is persisted between the scalar
    action and the output plan; lost blocks are recomputed from lineage.
    """
    gen = apply_generalisation(df, age, location, date, width)
    qi = (f"{age}_gen", location, date)
    nums = [c for c in numeric_cols if c in df.columns]
    measures = ([age] if age in df.columns else []) + nums
    gen_m = gen.withColumns({m: _nan_to_null(m) for m in measures}) if measures else gen
    classes = (gen_m.groupBy(*qi)
               .agg(F.count(F.lit(1)).alias("class_size"),
                    *[F.min(m).alias(f"_min_{m}") for m in measures],
                    *[F.max(m).alias(f"_max_{m}") for m in measures])
               .persist(StorageLevel.MEMORY_AND_DISK))
    kept = F.col("class_size") >= k
    stat_cols = [
        F.sum("class_size").alias("records_in"),
        F.coalesce(F.sum(F.when(kept, F.col("class_size"))), F.lit(0)).alias("records_out"),
        F.count(F.when(kept, F.lit(1))).alias("classes_out"),
    ]
    if age in df.columns:
        stat_cols += [F.min(f"_min_{age}").alias("_age_lo"), F.max(f"_max_{age}").alias("_age_hi")]
    for c in nums:
        stat_cols += [F.min(F.when(kept, F.col(f"_min_{c}"))).alias(f"_lo_{c}"),
                      F.max(F.when(kept, F.col(f"_max_{c}"))).alias(f"_hi_{c}")]
    stats = classes.agg(*stat_cols)
    loss = (_loss_expr(F.col("_age_lo"), F.col("_age_hi"), width) if age in df.columns
            else F.lit(0.0))
    report = stats.select(
        F.coalesce(F.col("records_in"), F.lit(0)).cast("bigint").alias("records_in"),
        F.col("records_out").cast("bigint").alias("records_out"),
        F.col("classes_out").cast("bigint").alias("classes_out"),
        loss.alias("information_loss"),
        _risk_expr(F.col("classes_out"), F.col("records_out")).alias("reid_risk"))

    sens = {}
    if nums:
        row = stats.first()
        sens = {c: _sensitivity(row[f"_lo_{c}"], row[f"_hi_{c}"]) for c in nums}
    keep = classes.where(kept).select(*qi)
    # null-safe, though no generalised value is null: else the optimiser asks for that in a copy of all expressions below
    names = [f"{c}_kept" for c in qi]
    same = reduce(lambda a, b: a & b, (F.col(f"`{c}`").eqNullSafe(F.col(f"`{n}`")) for c, n in zip(qi, names)))
    anonymised = gen.join(keep.toDF(*names), same, "left_semi").select(*qi, *(f"`{c}`" for c in gen.columns if c not in qi))
    anonymised = laplace_noise(anonymised, nums, epsilon, key=key, salt=salt, seed=seed,
                               sensitivity=sens, bounds=bounds)
    return Deidentified(anonymised.drop(*drop), report, (classes,))
