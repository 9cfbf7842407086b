"""One reduction of dense arrays for all operators that add up partial results: histograms, sums of clusters, Gram matrices, tile products.

Partial results are rows (keys ..., lane, value): one array a key and lane, a lane being a task, a block or the like. In
each level ``arity`` neighbouring lanes of a key are added up in one group, so that no group holds more than
``arity`` arrays however many tasks there are, and a level's arrays are 1 / ``arity`` of those before.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ARITY = 48


def lanes_of(df: DataFrame) -> int:
    """The number of tasks, and so of partial results, of what reads a table or what is kept."""
    return max(1, df.rdd.getNumPartitions())


def levels(lanes: int, arity: int = ARITY) -> list[int]:
    """How many lanes are left after each level."""
    out = []
    while not out or out[-1] > 1:
        out.append(math.ceil(max(1, out[-1] if out else lanes) / arity))
    return out


def sum_arrays(parts: DataFrame, keys: Sequence[str], lanes: int, arity: int = ARITY) -> DataFrame:
    """keys ..., value of a table (keys ..., lane, value array<double>): the sums over lanes 0 .. lanes - 1.

    A key's arrays have one length; those of other lengths than its first are an error.
    """
    if arity < 2:
        raise ValueError("arity must be 2 or more")
    columns = [*keys, "lane", "value"]
    parts = parts.select(*keys, F.col("lane").cast("bigint").alias("lane"), F.col("value").cast("array<double>").alias("value"))
    schema = parts.schema

    def add(group: pa.Table) -> pa.Table:
        whole = group["value"].combine_chunks()
        sizes = np.diff(whole.offsets.to_numpy())
        if len(set(sizes.tolist())) > 1:
            raise ValueError("arrays of different lengths")
        total = np.asarray(whole.flatten()).reshape(group.num_rows, -1).sum(axis=0)
        first = group.slice(0, 1)
        return pa.table({**{c: first[c] for c in [*keys, "lane"]}, "value": pa.array([total], pa.list_(pa.float64()))}).select(columns)

    for _ in levels(lanes, arity):
        parts = parts.withColumn("lane", F.floor(F.col("lane") / arity).cast("bigint")).groupBy(*keys, "lane").applyInArrow(add, schema)
    return parts.drop("lane")
