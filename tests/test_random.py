"""Random columns by counter: the same in columns, in tasks and in SQL, under any partitioning."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from quarry.functions import random
from quarry.sources import generate


def test_column_task_and_sql_agree(spark):
    ids = [0, 1, 2, 3, -1, -7, 1 << 31, (1 << 40) + 5, -(1 << 50), (1 << 62) + 1]
    df = spark.createDataFrame([(i,) for i in ids], "i bigint")
    got = df.select("i", *[random.uniform(F.col("i"), c, 5, 1).alias(f"c{c}") for c in range(3)]).collect()
    want = random.uniform_matrix(np.array(ids), 3, 5, 1)
    assert [[r[f"c{c}"] for c in range(3)] for r in got] == want.tolist()
    values = ", ".join(f"({i}::bigint)" for i in ids)
    sql = duckdb.connect().execute(f"select {', '.join(random.uniform_sql('i', c, 5, 1) for c in range(3))} from (values {values}) t(i)").fetchall()
    assert [list(r) for r in sql] == want.tolist()
    n = df.select(random.normal(F.col("i"), 2, 5).alias("n")).collect()
    assert np.allclose([r["n"] for r in n], random.normal_matrix(np.array(ids), 3, 5)[:, 2], atol=1e-12)


def test_values_are_uniform_and_independent():
    u = random.uniform_matrix(np.arange(200_000), 4, 9)
    assert (0 <= u).all() and (u < 1).all() and np.abs(u.mean(axis=0) - 0.5).max() < 0.003
    for c in range(4):
        counts = np.bincount((u[:, c] * 100).astype(int), minlength=100)
        assert ((counts - 2000) ** 2 / 2000).sum() < 160  # chi square of 99 degrees of freedom
    assert np.abs(np.corrcoef(u.T) - np.eye(4)).max() < 0.01 and abs(np.corrcoef(u[:-1, 0], u[1:, 0])[0, 1]) < 0.01
    z = random.normal_matrix(np.arange(200_000), 2, 9)
    assert np.abs(z.mean(axis=0)).max() < 0.01 and np.abs(z.std(axis=0) - 1).max() < 0.01


def test_generated_points_do_not_depend_on_partitions(spark):
    one, many = (sorted(map(tuple, generate.random_points(spark, 500, 4, 3, n).collect())) for n in (1, 7))
    assert one == many and len(one) == 500
    blobs = [sorted(map(str, f(generate.blobs(spark, 300, seed=2)).collect())) for f in (lambda d: d, lambda d: d.repartition(5))]
    assert blobs[0] == blobs[1]
    cells = generate.block_matrix(spark, 2, 3, 4, seed=1)
    assert cells.count() == 8 * 12 and cells.select("x").distinct().count() == 8 * 12


def test_null_ids_and_nulls(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (None, [3.0, 4.0]), (3, None)], "row_id bigint, features array<double>")
    got = generate.with_noise(df, 0.0).orderBy(F.asc_nulls_last("row_id")).collect()
    assert got[0]["features"] == [1.0, 2.0] and len(got) == 2
    assert random.vectors(df.limit(0), "row_id", 2).collect() == []
