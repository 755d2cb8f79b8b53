"""Clustering against a plain version, and the bounds against full scans."""

import hashlib
import math

import numpy as np
import pytest
from test_llm_queries import ordered

from cohortshare.llm import ns_bounds, queries

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, distance string, v string"


def plain_clusters(rows, clusters=16, rounds=3, dimension=64):
    kept = [(i, [math.floor(64 * float(x)) for x in e]) for i, e in rows
            if e is not None and len(e) == dimension and all(x is not None and math.isfinite(x) for x in e)]
    if not kept:
        return []
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [list(v) for _, v in start[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(centres)):
            if mine := [v for (_, v), o in zip(kept, own) if o == j]:
                centres[j] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [nearest(v) for _, v in kept]
    total = sum(d for d, _ in last)
    sums = {j: sum(d for d, o in last if o == j) for j in range(len(centres))}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, j, d, sums[j], total, names[j]) for (i, _), (d, j) in zip(kept, last)]


def test_query_matches_the_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    out = queries.QUERIES["op12_centroid_clusters"](spark, sf)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert ordered(out.collect()) == ordered(plain_clusters(rows))


def test_awkward_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=64)]) for i in range(40)]
    rows += [(100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 65), (104, [None] + [1.0] * 63), (105, [math.nan] * 64),
             (106, [math.inf] + [0.0] * 63), (107, [0.0] * 64), (108, [0.0] * 64), rows[3], rows[3], (None, rows[4][1]), (None, None)]
    def table(rows):
        return spark.createDataFrame([(i, e, None, "c", "d", "v") for i, e in rows], SCHEMA).repartition(3)
    for part in (rows, rows[:5], [(None, rows[0][1])], [(7, [0.5] * 64)] * 30):
        shown = [(r.vec_id, r.embedding) for r in table(part).collect()]
        assert ordered(ns_bounds.cluster_vectors(table(part)).collect()) == ordered(plain_clusters(shown))
    assert ns_bounds.cluster_vectors(table(rows[40:47])).count() == 0
    assert ns_bounds.cluster_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(Exception, match="squared distances"):
        ns_bounds.cluster_vectors(table([(1, [1e30] * 64)])).collect()


@pytest.mark.parametrize("spread", [3, 40])
def test_bounds_are_exact_and_spare_distances(spread):
    """Many rounds: the same clusters as full scans, with fewer distances evaluated; ties go to the smaller number."""
    rng = np.random.default_rng(spread)
    heart = rng.integers(-200, 200, size=(8, 6))
    v = (heart[rng.integers(0, 8, size=600)] + rng.integers(-spread, spread + 1, size=(600, 6))).astype(np.int64)
    history = v[rng.permutation(600)[:9]][None]
    squares = ns_bounds.squared(v, history[-1])
    cluster, rounds, evaluated = squares.argmin(axis=1), np.zeros_like(squares), 0
    for i in range(12):
        new = history[-1].copy()
        for j in range(9):
            if (cluster == j).any():
                new[j] = v[cluster == j].sum(axis=0) // (cluster == j).sum()
        history = np.concatenate([history, new[None]])
        evaluated += ns_bounds.reassign(v, cluster, squares, rounds, history, exact=i % 5 == 4)
        full = ns_bounds.squared(v, history[-1])
        assert (cluster == full.argmin(axis=1)).all()
        for s in range(len(history)):
            at = rounds == s
            assert (squares[at] == ns_bounds.squared(v, history[s])[at]).all()
    assert evaluated < 0.5 * 12 * v.shape[0] * 9
    moved = ns_bounds.displacements(history)
    summed = [sum(np.sqrt(((history[t + 1] - history[t]) ** 2).sum(axis=1)) for t in range(s, len(history) - 1)) for s in range(len(history) - 1)]
    assert (moved[:-1] <= np.array(summed) + 1e-9).all()
