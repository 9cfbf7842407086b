"""Operators and sources against numpy, and the cases that no SQL covers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import kmeans, matrix, runlog, svm
from quarry.plans.catalog import QUERIES
from quarry.sources import generate
from quarry.streaming.histogram import windowed_histogram


def _table(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id bigint, features array<double>")


def _array(df):
    return np.array([r["features"] for r in df.orderBy("row_id").collect()])


@pytest.mark.parametrize("shape, block", [((60, 7), 3), ((40, 12), 4), ((30, 1), 5), ((5, 9), 2)])
def test_panel_svd_equals_numpy(spark, shape, block):
    x = np.random.default_rng(3).normal(size=shape) * np.logspace(0, -5, shape[1])
    u, s, v = matrix.panel_svd(_table(spark, x), block=block, sort=True)
    u, v = _array(u), _array(v)
    want = np.linalg.svd(x, compute_uv=False)
    n = min(shape)
    assert np.allclose(s[:n], want, rtol=1e-9, atol=0) and (s[n:] < 1e-13 * want[0]).all()
    assert np.allclose(v.T @ v, np.eye(shape[1]), atol=1e-12) and np.allclose(u[:, :n].T @ u[:, :n], np.eye(n), atol=1e-9)
    assert np.allclose(u * s @ v.T, x, atol=1e-12)


def test_a_task_turns_and_multiplies_its_rows_in_one_worker(spark, monkeypatch):
    plans, grams = [], matrix._pair_grams

    def seen(*a):
        out = grams(*a)
        plans.append(out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow"))
        return out

    monkeypatch.setattr(matrix, "_pair_grams", seen)
    x = np.random.default_rng(12).normal(size=(40, 6))
    s = matrix.panel_svd(_table(spark, x), block=2, sort=True)[1]
    assert np.allclose(s, np.linalg.svd(x)[1]) and len(plans) > 3 and set(plans) == {1}


def test_panel_svd_of_zero_and_dependent_columns(spark):
    x = np.random.default_rng(4).normal(size=(20, 6))
    x[:, 2], x[:, 4] = 0, 2 * x[:, 0]
    u, s, v = matrix.panel_svd(_table(spark, x), block=2)
    assert np.allclose(np.sort(s)[::-1], np.linalg.svd(x, compute_uv=False), atol=1e-12)
    assert np.allclose(_array(u) * s @ _array(v).T, x, atol=1e-12)


def test_rounds_meet_every_pair_once():
    for n in (1, 2, 3, 4, 7, 8):
        rounds = matrix.rounds_of(n)
        met = [p for r in rounds for p in r]
        assert sorted(met) == [(a, b) for a in range(n) for b in range(a + 1, n)]
        assert all(len({x for p in r for x in p}) == 2 * len(r) for r in rounds)


def test_kmeans_api(spark):
    x = np.random.default_rng(5).random((200, 3))
    points = _table(spark, x)
    model = kmeans.KMeans(n_clusters=4, random_state=7, max_iter=3).fit(points)
    assert model.centers is not None and len(model.centers) == 4 and model.n_iter == 3
    middle = np.random.default_rng(7).random((4, 3))
    for _ in range(3):
        near = np.sqrt(((x[:, None] - middle[None]) ** 2).sum(axis=2)).argmin(axis=1)
        middle = np.array([x[near == k].mean(axis=0) if (near == k).any() else middle[k] for k in range(4)])
    assert np.allclose(model.centers, middle, atol=1e-12)
    near = np.sqrt(((x[:, None] - middle[None]) ** 2).sum(axis=2)).argmin(axis=1)
    assert [r["k"] for r in model.predict(points).orderBy("row_id").collect()] == near.tolist()
    still = kmeans.KMeans(n_clusters=1, init=[x.mean(axis=0)], tol=1e-4).fit(points)
    assert still.n_iter == 1  # it moved less than tol squared
    for wrong in ("other", [[1.0, 2.0]]):
        with pytest.raises(ValueError, match="init"):
            kmeans.KMeans(n_clusters=2, init=wrong).fit(points)
    with pytest.raises(ValueError, match="fitted"):
        kmeans.KMeans().predict(points)


def test_kmeans_ties_go_to_the_lower_centre(spark):
    points = _table(spark, np.array([[0.0, 0.0], [1.0, 0.0], [5.0, 0.0]]))
    got = [r["k"] for r in kmeans.assign(points, [[2.0, 0.0], [-2.0, 0.0], [2.0, 0.0], [8.0, 0.0]]).orderBy("row_id").collect()]
    assert got == [0, 0, 0]


def test_cascade_equals_a_kernel_machine_on_all_rows(spark, monkeypatch):
    monkeypatch.setattr(svm, "GROUP_ROWS", 60)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 2))
    y = ((x**2).sum(axis=1) > 1.2).astype(int)
    rows = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, y, strict=True))], "row_id bigint, features array<double>, label int")
    model = svm.CascadeSVM(cascade_arity=3, gamma=1.0, check_convergence=True).fit(rows)
    assert 1 < model.n_iter <= 5
    w = svm.train_block(x, y, [0, 1], 1.0, 1.0)
    asked = rng.normal(size=(300, 2))
    want = ((svm.kernel(asked, x, 1.0) + 1.0) @ w).argmax(axis=1)
    got = np.array([r["prediction"] for r in model.predict(_table(spark, asked)).orderBy("row_id").collect()])
    assert (got == want).mean() >= 0.97 and (got == ((asked**2).sum(axis=1) > 1.2)).mean() >= 0.9


def test_linear_machines_and_clusters(spark, sf_dir):
    rows = generate.blobs(spark, 600, centers=4, dim=5)
    again = generate.blobs(spark, 600, centers=4, dim=5)
    assert rows.exceptAll(again).isEmpty() and rows.select("label").distinct().count() == 4
    middle = np.random.default_rng(generate.CENTER_SEED).uniform(-10, 10, (4, 5))
    found = rows.collect()
    for k in range(4):
        own = np.array([r["features"] for r in found if r["label"] == k])
        assert np.abs(own.mean(axis=0) - middle[k]).max() < 0.5 and np.abs(own.std(axis=0) - 1).max() < 0.3
    got = QUERIES["svm_cascade_predict"](spark, sf_dir).count()
    assert got == spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 5 = 0").count()


def test_generated_points_and_blocks(spark):
    points = np.array([r["features"] for r in generate.random_points(spark, 500, 4).collect()])
    assert points.shape == (500, 4) and (points >= 0).all() and (points < 1).all() and np.abs(points.mean(axis=0) - 0.5).max() < 0.06
    assert len(np.unique(points)) == 2000
    cells = generate.block_matrix(spark, 3, 2, 4).collect()
    assert sorted((r["i"], r["j"]) for r in cells) == [(i, j) for i in range(12) for j in range(8)]
    assert all(r["rb"] == r["i"] // 4 and r["cb"] == r["j"] // 4 and 0 <= r["x"] < 1 for r in cells)


def test_winsorized_and_quartiles_equal_numpy(spark):
    rng = np.random.default_rng(9)
    rows = [(["a", "b", None][i % 3], float(v) if i % 11 else None) for i, v in enumerate(rng.integers(0, 40, 300))] + [("c", 1.0), ("c", 9.0), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    want = []
    for k, v in rows:
        own = sorted(x for kk, x in rows if kk == k and x is not None)
        cap = own[len(own) - math.floor(len(own) * 0.1) - 1] if k is not None and len(own) >= 5 else math.inf
        want.append((k, v if v is None else min(v, cap)))
    key = lambda r: (r[0] or "", r[1] is None, r[1] or 0)
    assert sorted(map(tuple, runlog.winsorized(df, "v", ["k"]).collect()), key=key) == sorted(want, key=key)
    for r in runlog.quartiles(df, "v", ["k"]).collect():
        own = [v for k, v in rows if k == r["k"] and v is not None]
        got = [r[c] for c in ("low", "q1", "median", "q3", "high")]
        assert got == [None] * 5 if not own else np.allclose(got, np.quantile(own, [0, 0.25, 0.5, 0.75, 1]))


def test_histogram_of_a_stream(spark, tmp_path):
    rows = spark.range(100).select((F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(mins=F.col("id"))).alias("at"), (F.col("id") % 10 / 10).alias("x"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    counts = windowed_histogram(stream, [F.col("x")], 5, 0.0, 1.0, "at", "1 hour", "10 minutes")
    ended = counts.writeStream.format("memory").queryName("hist").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    ended.awaitTermination(120)
    found = {(r["w"]["start"].hour, r["b0"]): r["cnt"] for r in spark.table("hist").collect()}
    assert sum(found.values()) == 100 and found[0, 0] == 12 and found[1, 4] == 8
