"""Exact k nearest neighbours by Euclidean distance, in blocks.

Fit rows are dealt to shards and queries to blocks; every (shard, block) pair is one bounded group,
scanned with a matrix product, and only its best k a query are shuffled on. Ties go to the lower id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.vector import batch_matrix, uniform

SHARD_ROWS = 65536
QUERY_ROWS = 16384
MOST_CELLS = 1 << 20


def _least_ids(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of which equal vectors keep the k least ids: others can't be among the nearest.

    Only rows whose hash more than k rows share are compared, so that there is no copy of the others.
    """
    h = np.zeros(len(x), np.uint64)
    for j in range(x.shape[1]):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + (x[:, j] + 0.0).view(np.uint64)
    _, same, n = np.unique(h, return_inverse=True, return_counts=True)
    some = np.flatnonzero(n[same] > k)
    if not len(some):
        return ids, x
    some = some[np.argsort(ids[some], kind="stable")]
    _, group, n = np.unique((np.ascontiguousarray(x[some]) + 0.0).view(np.dtype((np.void, x.shape[1] * 8))).ravel(), return_inverse=True, return_counts=True)
    by = np.argsort(group, kind="stable")
    place = np.arange(len(by)) - np.repeat(np.cumsum(n) - n, n)
    keep = np.ones(len(ids), bool)
    keep[some[by[place >= k]]] = False
    return ids[keep], x[keep]


def best_of_block(fit_ids: np.ndarray, fit: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, neighbour, distance) of the best k of one block; candidates by product, distances by difference."""
    fit_ids, fit = _least_ids(fit_ids, fit, k)
    squares, out = np.einsum("ij,ij->i", fit, fit), []
    rows = max(1, min(512, MOST_CELLS // max(1, len(fit))))
    for first in range(0, len(queries), rows):
        part = queries[first : first + rows]
        size = (part**2).sum(axis=1)
        near = (-2 * part) @ fit.T
        near += squares
        near += size[:, None]
        if near.shape[1] > k:  # the product's rounding can't lose a neighbour or a tie
            kth = np.partition(near, k - 1, axis=1)[:, k - 1] + 1e-9 * (1 + squares.max(initial=0) + size)
            at, some = np.nonzero(~(near > kth[:, None]))
        else:
            at, some = (x.ravel() for x in np.indices(near.shape))
        dist = np.concatenate([np.sqrt(((fit[some[i : i + 65536]] - part[at[i : i + 65536]]) ** 2).sum(axis=1)) for i in range(0, len(at), 65536)] or [np.zeros(0)])
        order = np.lexsort((fit_ids[some], dist, at))
        at, some, dist = at[order], some[order], dist[order]
        best = np.arange(len(at)) - np.searchsorted(at, at) < k
        out.append((first + at[best], fit_ids[some[best]], dist[best]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class NearestNeighbors:
    """fit() keeps a table (row_id, features); kneighbors() asks it."""

    def __init__(self, n_neighbors: int = 5):
        self.n_neighbors = n_neighbors
        self._fit: DataFrame | None = None

    def fit(self, points: DataFrame, row_id: str = "row_id", features: str = "features") -> NearestNeighbors:
        self._fit, self._width = uniform(points.select(F.col(row_id).cast("bigint").alias("id"), F.col(features).alias("v")), "v")
        return self

    def kneighbors(self, queries: DataFrame, k: int | None = None, return_distance: bool = True, row_id: str = "row_id", features: str = "features") -> DataFrame:
        """query_id, rank, neighbor_id, dist. A query that is also a fit row finds itself."""
        if self._fit is None:
            raise ValueError("not fitted")
        k = k or self.n_neighbors
        asked, width = uniform(queries.select(F.col(row_id).cast("bigint").alias("id"), F.col(features).alias("v")), "v")
        if width and self._width and width != self._width:
            raise ValueError(f"queries of {width} dimensions, fit rows of {self._width}")
        n, q = self._fit.count(), asked.count()
        if n < k:
            raise ValueError(f"fewer than {k} fit rows")
        cores = self._fit.sparkSession.sparkContext.defaultParallelism
        shards = max(math.ceil(n / SHARD_ROWS), min(cores, math.ceil(n / 4096)))
        blocks = max(1, math.ceil(q / QUERY_ROWS))
        left = self._fit.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), "id", "v")
        right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b"), "id", "v")

        def group(a: pa.Table, b: pa.Table) -> pa.Table:
            at, ids, dist = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            if a.num_rows and b.num_rows:
                at, ids, dist = best_of_block(a["id"].to_numpy(), batch_matrix(a["v"]), batch_matrix(b["v"]), k)
            return pa.table({"query_id": b["id"].take(pa.array(at)), "neighbor_id": pa.array(ids, pa.int64()), "dist": pa.array(dist, pa.float64())})

        found = left.groupBy("s", "b").cogroup(right.groupBy("s", "b")).applyInArrow(group, "query_id bigint, neighbor_id bigint, dist double")
        best = Window.partitionBy("query_id").orderBy("dist", "neighbor_id")
        out = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "dist")
        return out if return_distance else out.drop("dist")


def merge(parts: DataFrame, k: int) -> DataFrame:
    """The best k a query of several structures' lists (query_id, neighbor_id, dist)."""
    best = Window.partitionBy("query_id").orderBy("dist", "neighbor_id")
    return parts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
