"""Centroid clustering with ns-bounds (norm of the sum of displacements) on integer vectors.

Every vector keeps, for each centroid, the exact squared distance when it was last evaluated and the round of that
evaluation. The driver keeps the history of all centroids, rounds x clusters x components integers. In a later round
the distance to a centroid differs from the stored one by at most the norm of that centroid's *total* displacement since
then (its present place minus its place in that round), which is at most the sum of the drifts round by round. So

* a centroid whose loosened lower bound is above the loosened upper bound of the vector's own centroid is not evaluated;
* where one is not excluded so, the own centroid is evaluated exactly and the test repeated;
* what still fails is evaluated exactly, and the smallest distance, then the smallest number, wins.

Bounds are compared with a margin far above the rounding of doubles, and distances are integers, so results are exact.
Each round is one pass over the vectors, which writes them with their new bounds, and one partial aggregate of a row per
cluster; the table of the round before is deleted. No vector goes through a shuffle or the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, ship, stored

DIMENSION = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
LIMIT = 1 << 27            # largest size of an integer component: 64 squared differences of this size fit a long
STATE = "vec_id long, v array<int>, cluster int, squares array<long>, rounds array<int>"


def _integers(dimension: int, scale: int):
    """(vec_id, embedding) -> (vec_id, v) of the vectors that are whole: ``dimension`` components, all finite."""
    def run(batches):
        for b in batches:
            col = b.column(1)
            sizes = np.asarray(col.value_lengths().fill_null(-1))
            rows = np.flatnonzero(sizes == dimension)
            flat = col.take(pa.array(rows)).flatten().cast(pa.float64())
            x = flat.to_numpy(zero_copy_only=False).reshape(-1, dimension)      # a null component becomes NaN
            whole = np.isfinite(x).all(axis=1)
            rows, x = rows[whole], np.floor(x[whole] * scale)
            if x.size and np.abs(x).max() > LIMIT:
                raise ValueError(f"a component times {scale} is beyond {LIMIT}: squared distances would not fit a long")
            v = pa.FixedSizeListArray.from_arrays(pa.array(x.astype(np.int32).reshape(-1)), dimension).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), v], ["vec_id", "v"])
    return run


def _matrix(column, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def squared(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``v`` to each centroid."""
    out = np.empty((len(v), len(centroids)), np.int64)
    for j, c in enumerate(centroids):
        d = v - c
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


def displacements(history: np.ndarray) -> np.ndarray:
    """[s, j]: norm of centroid j's displacement from round s to the last round."""
    return np.sqrt(((history[-1] - history) ** 2).sum(axis=2).astype(np.float64))


def reassign(v, cluster, squares, rounds, history, exact: bool) -> int:
    """Assign anew to ``history[-1]``, in place; returns the number of distances evaluated.

    ``squares[i, j]`` is the squared distance of vector i to centroid j as it was in round ``rounds[i, j]``. ``exact``: the
    own centroid's distance is evaluated for all vectors.
    """
    now, centroids, moved = len(history) - 1, history[-1], displacements(history)
    every = np.arange(len(v))
    drift = np.take_along_axis(moved, rounds, axis=0)
    distance = np.sqrt(squares.astype(np.float64))
    low = (distance - drift) * (1 - 1e-12) - 1e-9
    low[every, cluster] = np.inf
    nearest = low.min(axis=1, initial=np.inf)
    high = (distance[every, cluster] + drift[every, cluster]) * (1 + 1e-12)
    own = every if exact else np.flatnonzero(nearest <= high)
    if not len(own):
        return 0
    d = v[own] - centroids[cluster[own]]
    squares[own, cluster[own]] = np.einsum("ij,ij->i", d, d)
    rounds[own, cluster[own]] = now
    high[own] = np.sqrt(squares[own, cluster[own]].astype(np.float64)) * (1 + 1e-12)
    n = len(own)
    failed = np.flatnonzero(nearest <= high)
    open_, at = low[failed] <= high[failed, None], now
    for j in range(len(centroids)):
        rows = failed[open_[:, j]]
        d = v[rows] - centroids[j]
        squares[rows, j] = np.einsum("ij,ij->i", d, d)
        rounds[rows, j] = at
        n += len(rows)
    if len(failed):
        fresh = open_.copy()
        fresh[np.arange(len(failed)), cluster[failed]] = True
        candidates = np.where(fresh, squares[failed], np.iinfo(np.int64).max)
        cluster[failed] = candidates.argmin(axis=1)
    return n


def _round(history: np.ndarray, exact: bool):
    """One pass: (vec_id, v) or a state row -> the state after assignment to the last centroids of the history."""
    k, dimension = history.shape[1:]

    def run(batches):
        for b in batches:
            v = _matrix(b.column(1), dimension, np.int64)
            if b.num_columns == 2:
                squares = squared(v, history[-1])
                cluster, rounds = squares.argmin(axis=1), np.zeros_like(squares)
            else:
                cluster = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                squares, rounds = (_matrix(b.column(i), k, np.int64) for i in (3, 4))
                reassign(v, cluster, squares, rounds, history, exact)

            def lists(x, kind):
                return pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1), kind), k).cast(pa.list_(kind))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cluster, pa.int32()), lists(squares, pa.int64()),
                                              lists(rounds, pa.int32())], ["vec_id", "v", "cluster", "squares", "rounds"])
    return run


def _moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor of each cluster's mean; an empty cluster's centroid stays."""
    dimension = centroids.shape[1]
    sums = state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(dimension)))
    out = centroids.copy()
    for r in sums.collect():                 # a row per cluster
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dimension)]
    return out


def cluster_vectors(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimension: int = DIMENSION,
                    scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every whole vector.

    ``vectors`` has ``vec_id`` and ``embedding``. A vector that is null, has another number of components, or a null or
    non-finite one, is left out; a component beyond 2^27 after scaling is an error, as squared distances would overflow.
    Centroids start as the vectors with the smallest SHA-256 of ``1:<vec_id>`` (equal ids: smaller components first; null
    ids last); fewer vectors than ``clusters`` make fewer centroids. Repeated rows: equal results. No vector: no rows.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    state = stored(rows.mapInArrow(_integers(dimension, scale), "vec_id long, v array<int>"), "integer-vectors")
    name = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    first = state.select("v").orderBy(name.asc_nulls_last(), "v").limit(clusters).collect()
    if not first:
        return state.select("vec_id", F.lit(0).alias("cluster"), *(F.lit(0).cast("long").alias(c) for c in (
            "distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"))
    history = np.array([[r["v"] for r in first]], np.int64)
    for i in range(rounds + 1):
        before = state
        state = stored(before.mapInArrow(_round(history, exact=i == rounds), STATE), "clustered-vectors")
        discard(before)
        if i < rounds:
            history = np.concatenate([history, _moved(state, history[-1])[None]])
    last = state.select("vec_id", "cluster", F.get("squares", F.col("cluster")).alias("distance"))
    inertia = {r["cluster"]: r["sum"] for r in last.groupBy("cluster").agg(F.sum("distance").alias("sum")).collect()}
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in history[-1]]

    def of_cluster(values):
        return F.get(F.array(*(F.lit(x) for x in values)), F.col("cluster"))
    return last.select("vec_id", "cluster", "distance",
                       of_cluster([inertia.get(j, 0) for j in range(len(names))]).cast("long").alias("cluster_inertia"),
                       F.lit(sum(inertia.values())).cast("long").alias("inertia"), of_cluster(names).alias("centroid_sha256"))
