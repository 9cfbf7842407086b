"""Bootstrap intervals and binned densities by group, in one pass over the rows.

bootstrap_means() is the Poisson bootstrap: in each of B replicates a row counts as often as a Poisson draw of mean 1
by its own id says, so that every task can weigh its rows alone. Each task sums B weighted values and B weights a
group, in one array that the shared reduction adds up; intervals are percentiles of the replicates' means.

binned_density() spreads each row over the two nearest of ``bins`` places of its group's own grid and then sums the
kernel over bins, so that work is rows plus bins x grid a group instead of rows x grid.

Defined results: null values, NaN and null keys take no part. A replicate that draws no row has no mean and is left out. A group
of fewer than two rows or without spread has no density. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from quarry.functions.random import uniform_matrix
from quarry.functions.tables import written
from quarry.operators.reduction import lanes_of, sum_arrays

#: The distribution function of a Poisson variable of mean 1, as far as doubles tell it from 1.
POISSON = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(14)]
HELD_GROUPS = 5000


def _used(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    v = F.col(value).cast("double")
    return rows.withColumn(value, v).where(v.isNotNull() & ~F.isnan(v)).dropna(subset=list(by))


def _percentile(values: Column, q: float) -> Column:
    """Of a sorted array, between the two nearest places."""
    at = (F.size(values) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    a, b = F.get(values, low), F.get(values, F.least(low + 1, F.size(values) - 1))
    return a + (b - a) * (at - low)


def bootstrap_means(rows: DataFrame, by: Sequence[str], value: str, row_id: str, replicates: int = 200, level: float = 0.95, seed: int = 42) -> DataFrame:
    """by ..., n, mean, lo, hi. row_id: an integer column that tells rows apart; rows that share one share their draws."""
    rows = _used(rows, by, value).select(*by, F.col(row_id).cast("bigint").alias("_row"), F.col(value).alias("_value")).where("_row is not null")
    keys, cdf = [rows.schema[c] for c in by], np.array(POISSON)

    def partial(batches):
        from pyspark import TaskContext

        lane, held = TaskContext.get().partitionId(), {}

        def out():
            names, sums = list(held), list(held.values())
            columns = [pa.array([k[i] for k in names], kinds[i]) for i in range(len(by))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([lane] * len(names), pa.int64()), pa.array(sums, pa.list_(pa.float64()))], names=[*by, "lane", "value"])

        kinds = None
        for batch in batches:
            kinds = [c.type for c in batch.columns[: len(by)]]
            for first in range(0, batch.num_rows, 4096):
                part = batch.slice(first, 4096)
                names = list(zip(*(c.to_pylist() for c in part.columns[: len(by)]), strict=True)) if by else [()] * part.num_rows
                place = {k: i for i, k in enumerate(dict.fromkeys(names))}
                group = np.array([place[k] for k in names])
                order = np.argsort(group, kind="stable")
                v = part.column(len(by) + 1).to_numpy()[order, None]
                weights = np.searchsorted(cdf, uniform_matrix(part.column(len(by)).to_numpy()[order], replicates, seed), side="right").astype(float)
                both = np.concatenate([np.ones_like(v), v, weights * v, weights], axis=1)
                sums = np.add.reduceat(both, np.searchsorted(group[order], np.arange(len(place))), axis=0)
                for k, s in zip(place, sums, strict=True):
                    held[k] = held[k] + s if k in held else s
                if len(held) > HELD_GROUPS:
                    yield out()
                    held = {}
        if held:
            yield out()

    parts = rows.mapInArrow(partial, StructType([*keys, StructField("lane", LongType()), StructField("value", ArrayType(DoubleType()))]))
    total = sum_arrays(parts, list(by), lanes_of(rows))
    n, mean = F.get("value", F.lit(0)), F.get("value", F.lit(1)) / F.get("value", F.lit(0))
    sums, weights = F.slice("value", 3, replicates), F.slice("value", 3 + replicates, replicates)
    means = F.array_sort(F.filter(F.zip_with(sums, weights, lambda s, w: F.when(w > 0, s / w)), lambda m: m.isNotNull()))
    ranked = total.select(*by, n.cast("bigint").alias("n"), mean.alias("mean"), means.alias("means"))
    return ranked.select(*by, "n", "mean", _percentile(F.col("means"), (1 - level) / 2).alias("lo"), _percentile(F.col("means"), (1 + level) / 2).alias("hi"))


def binned_density(rows: DataFrame, by: Sequence[str], value: str, factor: float = 0.1, grid: int = 64, bins: int = 512, reach: float = 3.0) -> DataFrame:
    """by ..., at, x, density: a Gaussian kernel of ``factor`` sample deviations on a grid from ``reach`` kernels below the least value to as much above the largest."""
    rows = _used(rows, by, value).select(*by, F.col(value).alias("_value"))
    stats = rows.groupBy(*by).agg(F.count("*").alias("_n"), (F.stddev_samp("_value") * F.lit(float(factor))).alias("_h"), F.min("_value").alias("_lo"), F.max("_value").alias("_hi"))
    stats = stats.where("_n > 1 and _h > 0").withColumn("_start", F.col("_lo") - reach * F.col("_h"))
    stats = written(stats.withColumn("_step", (F.col("_hi") + reach * F.col("_h") - F.col("_start")) / F.lit(bins - 1.0)), "density")
    placed = rows.join(stats.select(*by, "_start", "_step"), list(by)).withColumn("_at", (F.col("_value") - F.col("_start")) / F.col("_step"))
    low = F.least(F.floor("_at"), F.lit(bins - 2)).cast("int")
    two = F.array(F.struct(low.alias("bin"), (low + 1 - F.col("_at")).alias("w")), F.struct((low + 1).alias("bin"), (F.col("_at") - low).alias("w")))
    weights = placed.select(*by, F.explode(two).alias("b")).groupBy(*by, "b.bin").agg(F.sum("b.w").alias("w"))
    listed = weights.groupBy(*by).agg(F.collect_list(F.struct("bin", "w")).alias("_bins")).join(stats, list(by))  # at most ``bins`` a group
    x = F.col("_start") + F.col("at") * (F.col("_step") * F.lit((bins - 1) / (grid - 1)))

    def kernel(s, b):
        z = (F.col("x") - (F.col("_start") + b["bin"] * F.col("_step"))) / F.col("_h")
        return s + b["w"] * F.exp(-0.5 * z * z)

    points = listed.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))).withColumn("x", x)
    density = F.aggregate("_bins", F.lit(0.0), kernel) / (F.col("_n") * F.col("_h") * F.lit(math.sqrt(2 * math.pi)))
    return points.select(*by, "at", "x", density.alias("density"))
