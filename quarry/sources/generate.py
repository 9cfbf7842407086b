"""Generated inputs: uniform and clustered points, block matrices, scaled fragments. Seeds are explicit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import random
from quarry.functions.vector import uniform

CENTER_SEED = 777


def random_points(spark: SparkSession, rows: int, dim: int, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """row_id, features: uniform in [0, 1), the same however many partitions there are."""
    return random.vectors(spark.range(0, rows, 1, partitions).withColumnRenamed("id", "row_id"), "row_id", dim, seed, "uniform", "features")


def blobs(spark: SparkSession, rows: int, centers: int = 15, dim: int = 20, seed: int = 42) -> DataFrame:
    """row_id, features, label: unit Gaussian noise around centres uniform in [-10, 10) of a fixed seed."""
    middle = np.random.default_rng(CENTER_SEED).uniform(-10, 10, (centers, dim)).tolist()
    table = F.array(*[F.array(*[F.lit(x) for x in row]) for row in middle])
    label = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(centers)).cast("int")
    rows_ = random.vectors(spark.range(rows).select(F.col("id").alias("row_id"), label.alias("label")), "row_id", dim, seed, "normal", "noise")
    return rows_.select("row_id", F.zip_with(F.get(table, F.col("label")), "noise", lambda a, b: a + b).alias("features"), "label")


def block_matrix(spark: SparkSession, row_blocks: int, col_blocks: int, block: int, seed: int = 42) -> DataFrame:
    """i, j, x: a block matrix of uniform cells in coordinate form, with the blocks each cell lies in."""
    rows, cols = row_blocks * block, col_blocks * block
    cells = spark.range(rows * cols).select((F.col("id") / cols).cast("bigint").alias("i"), (F.col("id") % cols).alias("j"), random.uniform(F.col("id"), 0, seed).alias("x"))
    return cells.select("i", "j", "x", F.floor(F.col("i") / block).alias("rb"), F.floor(F.col("j") / block).alias("cb"))


def with_noise(points: DataFrame, scale: float, seed: int = 42, row_id: str = "row_id", features: str = "features") -> DataFrame:
    """Points with a normal value of standard deviation ``scale`` added to every component, drawn by row id and component."""
    points, width = uniform(points, features)
    drawn = random.vectors(points, row_id, width, seed, "normal", "_noise")
    return drawn.withColumn(features, F.zip_with(features, "_noise", lambda x, e: x + F.lit(float(scale)) * e)).drop("_noise")


def min_max_scaled(points: DataFrame, features: str = "features") -> DataFrame:
    """Every cell less the one global minimum, over the largest cell left; not divided where that is zero."""
    r = points.agg(F.min(F.array_min(features)).alias("lo"), F.max(F.array_max(features)).alias("hi")).first()
    lo, width = r["lo"] or 0.0, (r["hi"] or 0.0) - (r["lo"] or 0.0)
    return points.withColumn(features, F.transform(features, lambda x: (x - F.lit(lo)) / F.lit(width or 1.0)))


def seconds_of(spark: SparkSession, values: dict[int, float]) -> DataFrame:
    """A literal dict as a table (units, seconds)."""
    return spark.createDataFrame([(int(k), float(v)) for k, v in values.items()], "units int, seconds double")
