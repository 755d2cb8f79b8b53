"""Registered imputation queries (missing cells injected by key, same rule in SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import impute as im
from ..sources.tables import table


def customer_missing(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select("c_custkey",
                    F.when(k % 7 == 0, F.lit(None).cast("double")).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
                    F.when(k % 11 == 0, F.lit(None).cast("double")).otherwise(F.col("c_nationkey").cast("double"))
                    .alias("c_nationkey"))


def lineitem_missing(spark, sf_dir, both: bool):
    li = table(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey")
    qty = F.when(k % 5 == 0, F.lit(None).cast("double")).otherwise(F.col("l_quantity")) if both \
        else F.col("l_quantity")
    return li.select("l_orderkey", "l_linenumber", qty.alias("l_quantity"),
                     F.when(k % 7 == 0, F.lit(None).cast("double")).otherwise(F.col("l_extendedprice"))
                     .alias("l_extendedprice"))


def _out(df):
    return df.select("l_orderkey", "l_linenumber", F.round("l_quantity", 4).alias("l_quantity"),
                     F.round("l_extendedprice", 4).alias("l_extendedprice"))


def q_count_missing(spark, sf_dir):
    return im.count_missing(customer_missing(spark, sf_dir), ["c_acctbal", "c_nationkey"])


def q_mice_one_column(spark, sf_dir):
    d = lineitem_missing(spark, sf_dir, both=False)
    return _out(im.impute(d, ["l_quantity", "l_extendedprice"], estimator="ols"))


def q_mice_two_columns(spark, sf_dir):
    d = lineitem_missing(spark, sf_dir, both=True)
    return _out(im.impute(d, ["l_quantity", "l_extendedprice"], estimator="ols"))


def q_mice_bayes(spark, sf_dir):
    d = lineitem_missing(spark, sf_dir, both=True)
    return _out(im.impute(d, ["l_quantity", "l_extendedprice"], estimator="bayes_ridge"))


def q_mice_customer(spark, sf_dir):
    d = customer_missing(spark, sf_dir)
    out = im.impute(d, ["c_acctbal", "c_nationkey"], estimator="ols")
    return out.select("c_custkey", F.round("c_acctbal", 4).alias("c_acctbal"),
                      F.round("c_nationkey", 4).alias("c_nationkey"))


QUERIES = {
    "count_missing": q_count_missing,
    "mice_one_column": q_mice_one_column,
    "mice_two_columns": q_mice_two_columns,
    "mice_bayes": q_mice_bayes,
    "mice_customer": q_mice_customer,
}


def _br_fit_ctes(name: str, tab: str, tgt: str, feat: str) -> list[str]:
    """Bayesian ridge with one feature as CTEs: moments, the evidence iteration as a
    recursive CTE (stop when |coef change| < 1e-3, at most 300 steps), final coef."""
    return [
        f"{name}_m AS MATERIALIZED (SELECT count(*) AS n, avg({feat}) AS mx, avg({tgt}_obs) AS my, "
        f"var_pop({feat}) * count(*) AS xtx, covar_pop({feat}, {tgt}_obs) * count(*) AS xty, "
        f"var_pop({tgt}_obs) * count(*) AS yty FROM {tab} WHERE {tgt}_obs IS NOT NULL)",
        f"{name}_it(it, alpha, lam, pc, stop) AS ("
        f"SELECT CAST(0 AS INTEGER), CAST(1.0 / (yty / n + {2.0 ** -52!r}) AS DOUBLE), CAST(1.0 AS DOUBLE), "
        f"CAST(NULL AS DOUBLE), false FROM {name}_m "
        f"UNION ALL SELECT it + 1, "
        f"(n - alpha * xtx / (lam + alpha * xtx) + 2e-6) / (greatest(yty - 2 * c * xty + c * c * xtx, 0.0) + 2e-6), "
        f"(alpha * xtx / (lam + alpha * xtx) + 2e-6) / (c * c + 2e-6), c, it <> 0 AND abs(pc - c) < 1e-3 "
        f"FROM (SELECT *, xty / (xtx + lam / alpha) AS c FROM {name}_it, {name}_m) s "
        f"WHERE NOT stop AND it < 300)",
        f"{name} AS MATERIALIZED (SELECT my - mx * b AS a, b FROM (SELECT m.mx, m.my, "
        f"m.xty / (m.xtx + i.lam / i.alpha) AS b FROM {name}_m m, "
        f"(SELECT * FROM {name}_it ORDER BY it DESC LIMIT 1) i) z)",
    ]


def _unrolled_ols(src: str, key: str, x: str, y: str, first: str, max_iter: int = 10, tol: float = 1e-3,
                  fit: str = "ols") -> str:
    """Chained regression rounds as CTEs; ``first`` is the column visited first (fewer missing)."""
    second = y if first == x else x
    ctes = [f"s0 AS MATERIALIZED (SELECT *, coalesce({x}_obs, avg({x}_obs) OVER ()) AS {x}0, "
            f"coalesce({y}_obs, avg({y}_obs) OVER ()) AS {y}0 FROM ({src}) src)"]
    cur = {x: f"{x}0", y: f"{y}0"}
    prev_tab = "s0"
    for r in range(1, max_iter + 1):
        for step, (tgt, feat) in enumerate([(first, second), (second, first)]):
            tab = f"s{r}_{step}"
            if fit == "ols":
                ctes.append(f"f{r}_{step} AS MATERIALIZED (SELECT regr_slope({tgt}_obs, {cur[feat]}) AS b, "
                            f"regr_intercept({tgt}_obs, {cur[feat]}) AS a FROM {prev_tab} "
                            f"WHERE {tgt}_obs IS NOT NULL)")
            else:
                ctes.extend(_br_fit_ctes(f"f{r}_{step}", prev_tab, tgt, cur[feat]))
            ctes.append(f"{tab} AS MATERIALIZED (SELECT {prev_tab}.*, coalesce({tgt}_obs, f.a + f.b * {cur[feat]}) "
                        f"AS {tgt}{r} FROM {prev_tab}, f{r}_{step} f)")
            cur[tgt] = f"{tgt}{r}"
            prev_tab = tab
        ctes.append(f"n{r} AS MATERIALIZED (SELECT max(abs({x}{r} - {x}{r - 1}) + abs({y}{r} - {y}{r - 1})) AS v "
                    f"FROM {prev_tab})")
    ctes.append(f"tolv AS (SELECT {tol} * max(v) AS t FROM (SELECT abs({x}_obs) AS v FROM s0 UNION ALL "
                f"SELECT abs({y}_obs) FROM s0) u)")

    def pick(c):
        whens = " ".join(f"WHEN (SELECT v FROM n{r}) < (SELECT t FROM tolv) THEN {c}{r}" for r in range(1, max_iter + 1))
        return f"CASE {whens} ELSE {c}{max_iter} END"
    return ("WITH RECURSIVE " + ",\n".join(ctes) +
            f"\nSELECT {key}, round({pick(x)}, 4) AS {x}, round({pick(y)}, 4) AS {y} FROM {prev_tab}")


_LI_ONE = """SELECT l_orderkey, l_linenumber, l_quantity AS l_quantity_obs,
                    CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice_obs
             FROM lineitem"""
_LI_TWO = """SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_quantity END AS l_quantity_obs,
                    CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice_obs
             FROM lineitem"""
_CUST = """SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal_obs,
                  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(c_nationkey AS DOUBLE) END AS c_nationkey_obs
           FROM customer"""

ORACLE = {
    "count_missing": """
  SELECT CAST(count(*) FILTER (WHERE c_custkey % 7 = 0) + count(*) FILTER (WHERE c_custkey % 11 = 0) AS BIGINT)
         AS n_missing FROM customer""",
    "mice_one_column": """
  WITH f AS (SELECT regr_slope(l_extendedprice_obs, l_quantity_obs) AS b,
                    regr_intercept(l_extendedprice_obs, l_quantity_obs) AS a FROM (""" + _LI_ONE + """) s)
  SELECT l_orderkey, l_linenumber, round(l_quantity_obs, 4) AS l_quantity,
         round(coalesce(l_extendedprice_obs, f.a + f.b * l_quantity_obs), 4) AS l_extendedprice
  FROM (""" + _LI_ONE + ") s, f",
    "mice_two_columns": _unrolled_ols(_LI_TWO, "l_orderkey, l_linenumber", "l_quantity", "l_extendedprice",
                                      first="l_extendedprice"),
    "mice_customer": _unrolled_ols(_CUST, "c_custkey", "c_acctbal", "c_nationkey", first="c_nationkey"),
    "mice_bayes": _unrolled_ols(_LI_TWO, "l_orderkey, l_linenumber", "l_quantity", "l_extendedprice",
                                first="l_extendedprice", fit="bayes_ridge"),
}
