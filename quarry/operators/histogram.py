"""D-dimensional equi-width histograms. Cells are half open, the last one of each dimension closed."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.vector import batch_matrix, uniform


def cell(x: Column, lo: float, hi: float, bins: int) -> Column:
    """Cell number from 0; null outside [lo, hi], for NaN and for null."""
    n = F.when(x == hi, F.lit(bins)).otherwise(F.width_bucket(x, F.lit(float(lo)), F.lit(float(hi)), F.lit(bins)))
    return F.when((n >= 1) & (n <= bins), (n - 1).cast("int"))


def histogram(df: DataFrame, columns: Sequence[Column], bins: int, lo: float = 0.0, hi: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """b0 .. bD-1, cnt of the non-empty cells. Rows with a coordinate outside are dropped."""
    names = [f"b{i}" for i in range(len(columns))]
    cells = df.select(*by, *[cell(c, lo, hi, bins).alias(n) for n, c in zip(names, columns, strict=True)]).dropna(subset=names)
    return cells.groupBy(*by, *names).agg(F.count("*").alias("cnt"))


def merged(partials: DataFrame) -> DataFrame:
    """The sum of histograms of parts."""
    names = [c for c in partials.columns if c.startswith("b") and c[1:].isdigit()]
    return partials.groupBy(*names).agg(F.sum("cnt").alias("cnt"))


def dense(hist: DataFrame, bins: int) -> DataFrame:
    """All bins**D cells, zeros included: a histogram's own size, not its input's."""
    names = [c for c in hist.columns if c != "cnt"]
    grid = hist.sparkSession.range(bins ** len(names)).select(*[(F.floor(F.col("id") / bins**i) % bins).cast("int").alias(n) for i, n in enumerate(names)])
    return grid.join(hist, names, "left").select(*names, F.coalesce("cnt", F.lit(0).cast("bigint")).alias("cnt"))


def dense_partials(points: DataFrame, bounds: Sequence[tuple[float, float]], bins: int, features: str = "features") -> DataFrame:
    """lane, value: each task's counts of all bins ** len(bounds) cells as one dense array, first dimension fastest, for reduction.sum_arrays().

    The vectors' first components are counted, as many as there are bounds; rows with one outside, or NaN, are not.
    """
    lo, hi = np.array([a for a, _ in bounds]), np.array([b for _, b in bounds])
    size, steps = bins ** len(bounds), bins ** np.arange(len(bounds))

    def count(batches):
        from pyspark import TaskContext

        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                x = batch_matrix(batch.column(0))[:, : len(lo)]
                inside = ((x >= lo) & (x <= hi)).all(axis=1)
                at = np.minimum(np.floor((x[inside] - lo) / ((hi - lo) / bins)).astype(np.int64), bins - 1)
                total += np.bincount(at @ steps, minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total], pa.list_(pa.float64()))], names=["lane", "value"])

    rows, width = uniform(points.select(features), features)
    if width and width < len(bounds):
        raise ValueError(f"vectors of {width} components, {len(bounds)} bounds")
    return rows.mapInArrow(count, "lane bigint, value array<double>")
