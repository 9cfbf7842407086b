"""Lloyd's k-means. Points stay distributed; only k * d sums come to the driver in a round."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from quarry.functions.vector import batch_matrix, checked, uniform
from quarry.operators.reduction import lanes_of, sum_arrays

Centers = list[list[float]]


def _nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and distance of each row's nearest centre; centres that the product can't tell apart are compared by difference."""
    near = (centers**2).sum(axis=1)[None] - 2 * x @ centers.T
    best = near.argmin(axis=1)
    least = near[np.arange(len(x)), best]
    slack = 1e-9 * (1 + (x**2).sum(axis=1) + (centers**2).sum(axis=1).max())
    close = np.flatnonzero((near <= (least + slack)[:, None]).sum(axis=1) > 1)
    for i in close:
        some = np.flatnonzero(near[i] <= least[i] + slack[i])
        best[i] = some[np.sqrt(((centers[some] - x[i]) ** 2).sum(axis=1)).argmin()]
    return best, np.sqrt(((x - centers[best]) ** 2).sum(axis=1))


def assign(points: DataFrame, centers: Centers, features: str = "features") -> DataFrame:
    """points with k and dist of the nearest centre; the lowest index wins a tie. One matrix product a batch. Rows with nulls take no part."""
    middle, place = np.array(centers, dtype=np.float64), points.columns.index(features)
    points = checked(points, middle.shape[1], features)

    def near(batches):
        for batch in batches:
            if batch.num_rows:
                k, dist = _nearest(batch_matrix(batch.column(place)), middle)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(k, pa.int32()), pa.array(dist)], names=[*batch.schema.names, "k", "dist"])

    return points.mapInArrow(near, StructType([*points.schema.fields, StructField("k", IntegerType()), StructField("dist", DoubleType())]))


def partial_sums(points: DataFrame, centers: Centers, features: str = "features") -> DataFrame:
    """k, pos, sum, n: each task adds its points up, one array of d sums and the count for each centre it met."""
    middle = np.array(centers, dtype=np.float64)

    def add(batches):
        from pyspark import TaskContext

        total, count = np.zeros_like(middle), np.zeros(len(middle))
        for batch in batches:
            if batch.num_rows:
                x = batch_matrix(batch.column(0))
                k, _ = _nearest(x, middle)
                count += np.bincount(k, minlength=len(middle))
                for c in np.unique(k):
                    total[c] += x[k == c].sum(axis=0)
        met = np.flatnonzero(count)
        lane = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array([lane] * len(met), pa.int64()), pa.array(list(np.column_stack([count, total])[met]), pa.list_(pa.float64()))], names=["k", "lane", "value"])

    rows = checked(points.select(features), middle.shape[1], features)
    sums = sum_arrays(rows.mapInArrow(add, "k int, lane bigint, value array<double>"), ["k"], lanes_of(rows))
    cut = sums.select("k", F.element_at("value", 1).cast("bigint").alias("n"), F.slice("value", 2, middle.shape[1]).alias("v"))
    return cut.select("k", "n", F.posexplode("v").alias("pos", "sum")).select("k", "pos", "sum", "n")


def recompute(sums: DataFrame, centers: Centers, empty: str = "keep") -> Centers:
    """New centres. A centre without points keeps its place, or goes with empty='drop'."""
    if empty not in ("keep", "drop"):
        raise ValueError("empty must be 'keep' or 'drop'")
    found: dict[int, dict[int, float]] = {}
    for r in sums.collect():  # k * d rows
        found.setdefault(r["k"], {})[r["pos"]] = r["sum"] / r["n"]
    out = []
    for k, old in enumerate(centers):
        if k in found:
            out.append([found[k][j] for j in range(len(old))])
        elif empty == "keep":
            out.append(list(old))
    return out


def shift(old: Centers, new: Centers) -> float:
    """Sum of the distances between paired centres."""
    return sum(math.dist(a, b) for a, b in zip(old, new, strict=True))


class KMeans:
    """fit() until the shift is under tol squared, or max_iter rounds."""

    def __init__(self, n_clusters: int = 8, init: str | Sequence[Sequence[float]] = "random", max_iter: int = 10, tol: float = 1e-4, random_state: int | None = 0, empty: str = "keep"):
        self.n_clusters, self.init, self.max_iter, self.tol, self.random_state, self.empty = n_clusters, init, max_iter, tol, random_state, empty
        self.centers: Centers | None = None
        self.n_iter = 0

    def _start(self, width: int) -> Centers:
        if isinstance(self.init, str):
            if self.init != "random":
                raise ValueError("init must be 'random' or an array")
            return np.random.default_rng(self.random_state).random((self.n_clusters, width)).tolist()
        start = [list(map(float, row)) for row in self.init]
        if len(start) != self.n_clusters or any(len(r) != width for r in start):
            raise ValueError(f"init must have shape ({self.n_clusters}, {width})")
        return start

    def fit(self, points: DataFrame, features: str = "features") -> KMeans:
        points = points.select(features).persist()
        try:
            width = uniform(points, features)[1]
            if not width:
                raise ValueError("no points")
            self.centers, self.n_iter = self._start(width), 0
            while self.n_iter < self.max_iter:
                old = self.centers
                self.centers = recompute(partial_sums(points, old, features), old, self.empty)
                self.n_iter += 1
                if len(old) == len(self.centers) and shift(old, self.centers) < self.tol**2:
                    break
        finally:
            points.unpersist()
        return self

    def predict(self, points: DataFrame, features: str = "features") -> DataFrame:
        if self.centers is None:
            raise ValueError("not fitted")
        return assign(points, self.centers, features)
