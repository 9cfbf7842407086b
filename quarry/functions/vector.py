"""Dense vectors as ARRAY<DOUBLE> columns: distances, norms, products, rotations as built-in expressions, and their rule for nulls."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def rotate(v: Column, matrix: Sequence[Sequence[float]]) -> Column:
    """The row vector times a small matrix."""
    columns = zip(*matrix, strict=True)
    return F.array(*[dot(v, literal(c)) for c in columns])


def nearest(v: Column, centers: Sequence[Sequence[float]]) -> Column:
    """struct(d, k) of the nearest centre; the lowest index wins a tie."""
    return F.array_min(F.array(*[F.struct(distance(v, literal(c)).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(centers)]))


def rbf(a: Column, b: Column, gamma: float) -> Column:
    return F.exp(-F.lit(gamma) * squared_distance(a, b))


def checked(rows: DataFrame, width: int, features: str = "features") -> DataFrame:
    """Rows with their vectors as doubles, by the rule of all operators on vectors: rows with a null vector, or one with a
    null component, take no part; vectors of other lengths than ``width`` are an error. NaN and infinity are numbers like any other.
    """
    rows = rows.withColumn(features, doubles(F.col(features))).where(F.col(features).isNotNull() & ~F.exists(features, lambda x: x.isNull()))
    same = F.when(F.size(features) == width, F.col(features)).otherwise(F.raise_error(F.lit(f"vectors of different lengths: {width} and others")))
    return rows.withColumn(features, same)


def uniform(rows: DataFrame, features: str = "features") -> tuple[DataFrame, int]:
    """checked() rows, and the vectors' length as the first of them has it (0 if there is none)."""
    fine = F.col(features).isNotNull() & ~F.exists(features, lambda x: x.isNull())
    first = rows.where(fine).select(F.size(features).alias("n")).first()
    width = first["n"] if first else 0
    return checked(rows, width, features), width


def batch_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors of an Arrow column as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))
