"""Side-by-side check of a registered query against its DuckDB oracle (as the driver does)."""

from __future__ import annotations

import math
import os

import duckdb

from cohortshare.sources.tables import TABLES


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf_dir, t + '.parquet')}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def compare(spark, name, qfn, sql, sf_dir):
    sdf = qfn(spark, sf_dir)
    srows = [r.asDict(recursive=True) for r in sdf.collect()]
    con = duck(sf_dir)
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = [dict(zip(dcols, r)) for r in res.fetchall()]
    scols = sorted(sdf.columns)
    problems = []
    if scols != sorted(dcols):
        problems.append(f"columns {scols} vs {sorted(dcols)}")
        return problems, len(srows), len(drows)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    s = sorted((tuple(_norm(r[c]) for c in scols) for r in srows), key=key)
    d = sorted((tuple(_norm(r[c]) for c in scols) for r in drows), key=key)
    if len(s) != len(d):
        problems.append(f"rows {len(s)} vs {len(d)}")
    bad = [(a, b) for a, b in zip(s, d) if a != b]
    if bad:
        problems.append(f"{len(bad)} differing rows, first: spark={bad[0][0]} duck={bad[0][1]}")
    return problems, len(s), len(d)
