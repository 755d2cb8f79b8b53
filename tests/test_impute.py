import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortshare.operators import impute as im


def _br_fit(X, y):
    """Bayesian ridge on raw matrices, as the library does it (SVD, centred, intercept)."""
    xm, ym = X.mean(axis=0), y.mean()
    Xc, yc = X - xm, y - ym
    n, p = Xc.shape
    eps = np.finfo(np.float64).eps
    alpha, lam = 1.0 / (np.var(yc) + eps), 1.0
    U, S, Vh = np.linalg.svd(Xc, full_matrices=False)
    ev = S ** 2
    xty = Xc.T @ yc
    old = None

    def upd(alpha, lam):
        coef = Vh.T @ (Vh / (ev + lam / alpha)[:, None]) @ xty
        return coef, np.sum((yc - Xc @ coef) ** 2)
    for it in range(300):
        coef, rmse = upd(alpha, lam)
        gamma = np.sum((alpha * ev) / (lam + alpha * ev))
        lam = (gamma + 2e-6) / (np.sum(coef ** 2) + 2e-6)
        alpha = (n - gamma + 2e-6) / (rmse + 2e-6)
        if it != 0 and np.sum(np.abs(old - coef)) < 1e-3:
            break
        old = coef.copy()
    coef, _ = upd(alpha, lam)
    return coef, ym - xm @ coef


def _ols_fit(X, y):
    A = np.column_stack([np.ones(len(X)), X])
    sol = np.linalg.lstsq(A, y, rcond=None)[0]
    return sol[1:], sol[0]


def brute_impute(X, fit, max_iter=10, tol=1e-3):
    mask = np.isnan(X)
    Xt = np.where(mask, np.nanmean(X, axis=0), X)
    order = [j for j in np.argsort(mask.mean(axis=0), kind="mergesort") if mask[:, j].any()]
    ntol = tol * np.max(np.abs(X[~mask]))
    prev = Xt.copy()
    for _ in range(max_iter):
        for j in order:
            others = [k for k in range(X.shape[1]) if k != j]
            obs = ~mask[:, j]
            coef, b = fit(Xt[obs][:, others], Xt[obs, j])
            Xt[mask[:, j], j] = Xt[mask[:, j]][:, others] @ coef + b
        if np.linalg.norm(Xt - prev, ord=np.inf, axis=None) < ntol:
            break
        prev = Xt.copy()
    return Xt


def _data(seed, n=400):
    rng = np.random.default_rng(seed)
    z = rng.normal(size=(n, 1))
    X = np.column_stack([50 + 10 * z[:, 0] + rng.normal(size=n), 3 * z[:, 0] + rng.normal(size=n) * 2,
                         rng.normal(size=n) + 0.5 * z[:, 0]])
    m = rng.random((n, 3)) < np.array([0.25, 0.15, 0.3])
    X[m] = np.nan
    return X


@pytest.mark.parametrize("estimator,fit", [("ols", _ols_fit), ("bayes_ridge", _br_fit)])
def test_pattern_form_equals_row_by_row(spark, estimator, fit):
    X = _data(1)
    rows = [(i, *[None if np.isnan(v) else float(v) for v in X[i]], "keep") for i in range(len(X))]
    df = spark.createDataFrame(rows, "i long, a double, b double, c double, other string")
    out = im.impute(df, ["a", "b", "c"], estimator=estimator).orderBy("i").collect()
    got = np.array([[r.a, r.b, r.c] for r in out])
    exp = brute_impute(X, fit)
    assert np.max(np.abs(got - exp)) < 1e-7
    assert all(r.other == "keep" for r in out)
    obs = ~np.isnan(X)
    assert np.array_equal(got[obs], X[obs])          # observed cells unchanged


def test_count_missing_and_errors(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), 2.0), (None, None)], "age_months double, lab_value double")
    assert im.count_missing(df).first().n_missing == 4
    allmiss = spark.createDataFrame([(1.0, None), (2.0, None)], "age_months double, lab_value double")
    with pytest.raises(ValueError):
        im.impute(allmiss)
    full = spark.createDataFrame([(1.0, 3.0), (2.0, 4.0)], "age_months double, lab_value double")
    assert im.impute(full).collect() == full.collect()
    out = im.impute(spark.createDataFrame([(1.0, 10.0), (2.0, 20.0), (3.0, None)],
                                          "age_months double, lab_value double"), estimator="ols")
    assert abs(out.where(F.col("age_months") == 3.0).first().lab_value - 30.0) < 1e-9


def test_table_path_equals_case_path(spark):
    X = _data(5, n=300)
    rows = [(i, *[None if np.isnan(v) else float(v) for v in X[i]]) for i in range(len(X))]
    df = spark.createDataFrame(rows, "i long, a double, b double, c double")
    a = im.impute(df, ["a", "b", "c"]).orderBy("i").collect()
    b = im.impute(df, ["a", "b", "c"], case_limit=0).orderBy("i").collect()
    assert len(a) == len(b) == 300
    for x, y in zip(a, b):
        assert x.i == y.i and all(abs(getattr(x, c) - getattr(y, c)) < 1e-9 for c in "abc")


def test_many_columns_table_path_equals_row_by_row(spark):
    rng = np.random.default_rng(11)
    n, p = 500, 6
    z = rng.normal(size=(n, 2))
    X = z @ rng.normal(size=(2, p)) + 0.3 * rng.normal(size=(n, p)) + np.arange(p) * 10
    X[rng.random((n, p)) < 0.2] = np.nan
    cols = [f"c{j}" for j in range(p)]
    rows = [(i, *[None if np.isnan(v) else float(v) for v in X[i]]) for i in range(n)]
    df = spark.createDataFrame(rows, "i long, " + ", ".join(f"{c} double" for c in cols))
    out = im.impute(df, cols, estimator="ols", case_limit=0).orderBy("i").collect()
    got = np.array([[getattr(r, c) for c in cols] for r in out])
    exp = brute_impute(X, _ols_fit)
    assert np.max(np.abs(got - exp)) < 1e-6


def test_thirty_three_columns_on_the_table_path(spark):
    cols = [f"c{i}" for i in range(33)]
    rows = [tuple(None if (r * 5 + i) % 17 == 0 or (i == 32 and r % 9 == 1) else float(r % 7 + i * (r % 3)) for i in range(33)) for r in range(120)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols))
    out = im.impute(df, cols, max_iter=2, estimator="ols", case_limit=0).collect()
    assert len(out) == 120 and all(x is not None for r in out for x in r)
