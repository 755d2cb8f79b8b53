"""Chained-regression (MICE) imputation of numeric columns in three passes.

Semantics follow the iterative imputer the reference calls (public library
behaviour): start from column means; visit the columns in ascending order of
missing count; regress each on all the others over the rows where it is
observed, using the current filled values, and overwrite its missing cells;
repeat up to ``max_iter`` rounds; stop after the first round whose change
(max over rows of the summed absolute change) falls below
``tol * max|observed value|``.  Observed cells never change.

Why three passes suffice: inside a missing-value pattern every filled value is
an affine function of the row's observed values, and each regression only
needs the Gram matrix of the current filled values, which is
``sum_p W_p M_p W_p^T`` over patterns p, with M_p the pattern's moment matrix
of the observed values.  So:

1. one aggregate grouped by missing pattern (<= 2^p groups, partial
   aggregation, centred co-moments via ``covar_pop``) yields every M_p;
2. all rounds run on the driver over these small matrices; one aggregate
   then evaluates the exact stopping norm of every round at once;
3. the output is one projection: a ``CASE`` on the pattern per column, or,
   with many patterns, a broadcast table of per-pattern coefficients joined
   on the pattern id.

Estimators: ``bayes_ridge`` (the library default, evidence maximisation after
MacKay 1992, fitted from the Gram matrix) and ``ols``.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The numeric columns of the record table and the defaults.
NUMERIC_COLS = ("age_months", "lab_value")
MAX_ITER = 10
TOL = 1e-3


def _num(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)


def missing_cells(cols=NUMERIC_COLS) -> Column:
    """D1 as an aggregate, also for ``observe``: the missing (NULL or NaN) cells over ``cols``."""
    return reduce(lambda a, b: a + b, [F.count(F.when(_num(c).isNull(), 1)) for c in cols]).cast("bigint")


def count_missing(df: DataFrame, cols=NUMERIC_COLS) -> DataFrame:
    """Total missing (NULL or NaN) cells over ``cols``."""
    return df.agg(missing_cells(cols).alias("n_missing"))


def missing_pattern(cols) -> Column:
    """Bit j set when column j is missing (a long: up to 63 columns)."""
    if len(cols) > 63:
        raise ValueError("missing patterns are kept in a long: at most 63 columns at once")
    return reduce(lambda a, b: a + b, [F.when(_num(c).isNull(), F.lit(1 << j).cast("long")).otherwise(F.lit(0).cast("long"))
                                       for j, c in enumerate(cols)])


def pattern_moments(df: DataFrame, cols=NUMERIC_COLS) -> DataFrame:
    """Per missing pattern: count, means, centred co-moments, min, max."""
    p = len(cols)
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.avg(_num(c)).alias(f"m{j}") for j, c in enumerate(cols)]
    aggs += [F.covar_pop(_num(cols[i]), _num(cols[j])).alias(f"c{i}_{j}") for i in range(p) for j in range(i, p)]
    aggs += [F.min(_num(c)).alias(f"lo{j}") for j, c in enumerate(cols)]
    aggs += [F.max(_num(c)).alias(f"hi{j}") for j, c in enumerate(cols)]
    return df.groupBy(missing_pattern(cols).alias("pattern")).agg(*aggs)


# ------------------------------------------------------------------ estimators on sufficient statistics

def fit_ols(xtx: np.ndarray, xty: np.ndarray, yty: float, n: float) -> np.ndarray:
    return np.linalg.lstsq(xtx, xty, rcond=None)[0]


def fit_bayes_ridge(xtx: np.ndarray, xty: np.ndarray, yty: float, n: float, n_iter: int = 300,
                    tol: float = 1e-3, alpha_1: float = 1e-6, alpha_2: float = 1e-6,
                    lambda_1: float = 1e-6, lambda_2: float = 1e-6) -> np.ndarray:
    """Bayesian ridge (evidence maximisation) from centred X'X, X'y, y'y and n."""
    eps = np.finfo(np.float64).eps
    alpha = 1.0 / (yty / n + eps)
    lam = 1.0
    evals, vecs = np.linalg.eigh(xtx)
    evals = np.clip(evals, 0.0, None)
    vty = vecs.T @ xty

    def coef_of(alpha, lam):
        return vecs @ (vty / (evals + lam / alpha))

    coef_old = None
    for it in range(n_iter):
        coef = coef_of(alpha, lam)
        rmse = max(yty - 2.0 * coef @ xty + coef @ xtx @ coef, 0.0)
        gamma = np.sum((alpha * evals) / (lam + alpha * evals))
        lam = (gamma + 2 * lambda_1) / (np.sum(coef ** 2) + 2 * lambda_2)
        alpha = (n - gamma + 2 * alpha_1) / (rmse + 2 * alpha_2)
        if it != 0 and np.sum(np.abs(coef_old - coef)) < tol:
            break
        coef_old = np.copy(coef)
    return coef_of(alpha, lam)


ESTIMATORS = {"ols": fit_ols, "bayes_ridge": fit_bayes_ridge}


def _moment_matrices(rows, p):
    n_obs = np.zeros(p)
    s_obs = np.zeros(p)
    for r in rows:
        for j in range(p):
            if not (r["pattern"] >> j) & 1:
                n_obs[j] += r["n"]
                s_obs[j] += r["n"] * r[f"m{j}"]
    if np.any(n_obs == 0):
        bad = [j for j in range(p) if n_obs[j] == 0]
        raise ValueError(f"columns entirely missing: {bad}")
    mu = s_obs / n_obs
    mats = {}
    for r in rows:
        pat, n = r["pattern"], float(r["n"])
        obs = [j for j in range(p) if not (pat >> j) & 1]
        d = np.zeros(p + 1)
        d[0] = 1.0
        for j in obs:
            d[1 + j] = r[f"m{j}"] - mu[j]
        m = n * np.outer(d, d)
        for a in obs:
            for b in obs:
                i, j = min(a, b), max(a, b)
                m[1 + a, 1 + b] += n * r[f"c{i}_{j}"]
        mats[pat] = m
    return mu, mats


def plan_imputation(moments: list, cols, *, max_iter: int = MAX_ITER, estimator: str = "bayes_ridge"):
    """Run every round on the pattern moments; returns (mu, per-round coefficient maps, order)."""
    p = len(cols)
    fit = ESTIMATORS[estimator]
    mu, mats = _moment_matrices(moments, p)
    miss = np.zeros(p)
    for r in moments:
        for j in range(p):
            if (r["pattern"] >> j) & 1:
                miss[j] += r["n"]
    order = [int(j) for j in np.argsort(miss, kind="mergesort") if miss[j] > 0]
    a = {}
    for pat in mats:
        m = np.zeros((p, p + 1))
        for j in range(p):
            if not (pat >> j) & 1:
                m[j, 1 + j] = 1.0
        a[pat] = m
    history = [{k: v.copy() for k, v in a.items()}]
    if p < 2:
        return mu, history, order
    for _ in range(max_iter):
        for j in order:
            s = np.zeros((p + 1, p + 1))
            for pat, m in mats.items():
                if not (pat >> j) & 1:
                    w = np.vstack([np.eye(1, p + 1), a[pat]])
                    s += w @ m @ w.T
            feats = [1 + f for f in range(p) if f != j]
            t = 1 + j
            n = s[0, 0]
            mx = s[0, feats] / n
            my = s[0, t] / n
            xtx = s[np.ix_(feats, feats)] - n * np.outer(mx, mx)
            xty = s[feats, t] - n * mx * my
            yty = s[t, t] - n * my * my
            coef = fit(xtx, xty, yty, n)
            b0 = my - mx @ coef
            others = [f for f in range(p) if f != j]
            for pat in a:
                if (pat >> j) & 1:
                    row = np.zeros(p + 1)
                    row[0] = b0
                    for cf, f in zip(coef, others):
                        row += cf * a[pat][f]
                    a[pat][j] = row
        history.append({k: v.copy() for k, v in a.items()})
    return mu, history, order


def _affine(row: np.ndarray, cols, mu, pat) -> Column:
    expr = F.lit(float(row[0]))
    for k, c in enumerate(cols):
        if not (pat >> k) & 1 and row[1 + k] != 0.0:
            expr = expr + F.lit(float(row[1 + k])) * (_num(c) - F.lit(float(mu[k])))
    return expr


CASE_LIMIT = 256   # pattern x round branches above which coefficient tables replace CASE expressions


def _centred(cols, mu) -> Column:
    """[1, x1 - mu1, ..., xp - mup] with 0 for a missing value (its coefficient is 0 anyway)."""
    return F.array(F.lit(1.0), *[F.coalesce(_num(c) - F.lit(float(mu[k])), F.lit(0.0)) for k, c in enumerate(cols)])


def _dot(coefs: Column, z: Column) -> Column:
    return F.aggregate(F.zip_with(coefs, z, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def _norms_by_case(df, cols, mu, history, pats):
    p = len(cols)
    pat_col = missing_pattern(cols)
    norms = []
    for rnd in range(1, len(history)):
        per = None
        for pat in pats:
            d = history[rnd][pat] - history[rnd - 1][pat]
            terms = [F.abs(_affine(d[j], cols, mu, pat)) for j in range(p) if (pat >> j) & 1 and np.any(d[j])]
            if not terms:
                continue
            e = reduce(lambda x, y: x + y, terms)
            per = F.when(pat_col == pat, e) if per is None else per.when(pat_col == pat, e)
        norms.append(F.max(per).alias(f"r{rnd}") if per is not None else F.lit(0.0).alias(f"r{rnd}"))
    return df.agg(*norms).first()


def _norms_by_table(df, cols, mu, history, pats):
    """The same norms with the per-pattern changes in a small broadcast table."""
    p = len(cols)
    rows = [(int(pat), [[(history[r][pat] - history[r - 1][pat])[j].tolist() for j in range(p) if (pat >> j) & 1]
                        for r in range(1, len(history))]) for pat in pats]
    cf = df.sparkSession.createDataFrame(rows, "_pat long, _d array<array<array<double>>>")
    z = df.select(missing_pattern(cols).alias("_pat"), _centred(cols, mu).alias("_z"))
    j = z.join(F.broadcast(cf), "_pat")
    norms = [F.max(F.aggregate(F.transform(F.get(F.col("_d"), r - 1), lambda row: F.abs(_dot(row, F.col("_z")))),
                               F.lit(0.0), lambda acc, x: acc + x)).alias(f"r{r}")
             for r in range(1, len(history))]
    return j.agg(*norms).first()


def _project_by_case(df, cols, mu, final, pats):
    pat_col = missing_pattern(cols)
    out = {}
    for j, c in enumerate(cols):
        e = None
        for pat in pats:
            if (pat >> j) & 1:
                val = F.lit(float(mu[j])) + _affine(final[pat][j], cols, mu, pat)
                e = F.when(pat_col == pat, val) if e is None else e.when(pat_col == pat, val)
        out[c] = e.otherwise(_num(c)) if e is not None else _num(c)
    return df.withColumns(out)


def _project_by_table(df, cols, mu, final, pats):
    """Fill via a broadcast table pattern -> coefficient rows (a broadcast join keeps the row side in place)."""
    p = len(cols)
    rows = [(int(pat), [final[pat][j].tolist() for j in range(p)]) for pat in pats]
    cf = df.sparkSession.createDataFrame(rows, "_pat long, _a array<array<double>>")
    staged = df.withColumns({"_pat": missing_pattern(cols), "_z": _centred(cols, mu)})
    j = staged.join(F.broadcast(cf), "_pat", "left")
    out = {c: F.when(_num(c).isNull(), F.lit(float(mu[k])) + _dot(F.get(F.col("_a"), k), F.col("_z")))
           .otherwise(_num(c)) for k, c in enumerate(cols)}
    return j.withColumns(out).select(*df.columns)


def impute(df: DataFrame, cols=NUMERIC_COLS, *, max_iter: int = MAX_ITER, tol: float = TOL,
           estimator: str = "bayes_ridge", case_limit: int = CASE_LIMIT) -> DataFrame:
    """H1: every column in ``cols`` filled; other columns untouched; observed cells unchanged.

    With few missing patterns the stopping norms and the fill are CASE
    expressions on the pattern; beyond ``case_limit`` pattern x round branches
    the per-pattern coefficients go to a small broadcast table (<= 2^p rows)
    joined on the pattern id, so the plan stays small for many columns.
    """
    cols = tuple(cols)
    p = len(cols)
    mom = pattern_moments(df, cols).collect()          # <= 2^p rows
    if not mom:
        return df
    if all(r["pattern"] == 0 for r in mom):
        return df
    mu, history, _ = plan_imputation([r.asDict() for r in mom], cols, max_iter=max_iter, estimator=estimator)
    pats = sorted(history[0])
    use_table = len(pats) * max(len(history) - 1, 1) > case_limit
    chosen = len(history) - 1
    if p >= 2 and max_iter > 0:
        obs_max = max(max(abs(r[f"lo{j}"]), abs(r[f"hi{j}"])) for r in mom for j in range(p)
                      if r[f"lo{j}"] is not None)
        ntol = tol * obs_max
        got = (_norms_by_table if use_table else _norms_by_case)(df, cols, mu, history, pats)
        for rnd in range(1, len(history)):
            v = got[f"r{rnd}"] or 0.0
            if v < ntol:
                chosen = rnd
                break
    return (_project_by_table if use_table else _project_by_case)(df, cols, mu, history[chosen], pats)
