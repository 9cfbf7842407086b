"""Queries over whole tables, which have no SQL, and operators in many blocks, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import knn, svm
from quarry.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def points(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    return np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=np.float64)


@pytest.mark.parametrize("name", ["knn_exact_whole", "knn_ids_only_whole", "knn_block_merge_whole", "knn_rotated_whole"])
def test_searches_ask_every_twentieth_row(spark, sf_dir, points, monkeypatch, name):
    monkeypatch.setattr(knn, "QUERY_ROWS", 7)
    ids, x = points
    x = x[:, :3] if name == "knn_rotated_whole" else x
    got = {(r["query_id"], r["rnk"]): r.asDict() for r in QUERIES[name](spark, sf_dir).collect()}
    assert {q for q, _ in got} == set(ids[ids % 20 == 0].tolist()) and len(got) == 5 * (ids % 20 == 0).sum()
    for q in ids[ids % 20 == 0]:
        dist = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        for n, i in enumerate(np.lexsort((ids, dist))[:5]):
            row = got[q, n + 1]
            assert row.get("neighbor_id", ids[i]) == ids[i] and abs(row.get("dist", dist[i]) - dist[i]) < 2e-6


def test_kernel_of_every_twentieth_row_with_all(spark, sf_dir, points, monkeypatch):
    monkeypatch.setattr(svm, "SHARD_ROWS", 50)
    ids, x = points
    got = {(r["a"], r["b"]): r["k"] for r in QUERIES["rbf_kernel_whole"](spark, sf_dir).collect()}
    asked = np.flatnonzero(ids % 20 == 0)
    assert len(got) == len(asked) * len(ids)
    for i in asked:
        want = np.exp(-0.5 * ((x - x[i]) ** 2).sum(axis=1))
        assert all(abs(got[ids[i], b] - k) < 2e-6 for b, k in zip(ids, want, strict=True))


def test_kernel_leaves_a_group_in_strips(spark, monkeypatch):
    for name, n in (("SHARD_ROWS", 40), ("ASKED_ROWS", 16), ("SORTED_CELLS", 100)):
        monkeypatch.setattr(svm, name, n)
    rng = np.random.default_rng(12)
    x = rng.normal(size=(120, 3))
    ids = [*range(117), 7, 7, None]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "row_id bigint, features array<double>")
    got = [(r["a"], -1 if r["b"] is None else r["b"], round(r["k"], 6)) for r in svm.kernel_table(rows.where("row_id < 50"), rows, 0.5).collect()]
    some = [i for i, n in enumerate(ids) if n is not None and n < 50]
    k = np.exp(-0.5 * ((x[some][:, None] - x[None]) ** 2).sum(axis=2))
    want = [(ids[i], -1 if b is None else b, round(float(c), 6)) for i, line in zip(some, k, strict=True) for b, c in zip(ids, line, strict=True)]
    assert len(got) == 52 * 120 and [g[:2] for g in sorted(got)] == [w[:2] for w in sorted(want)]
    assert np.abs(np.array([g[2] for g in sorted(got)]) - [w[2] for w in sorted(want)]).max() < 2e-6


def test_kernel_takes_few_bytes_a_cell(spark, tmp_path):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id bigint, features array<double>")
    table = svm.kernel_table(rows.where("row_id % 8 = 0"), rows, 0.5)
    table.withColumn("k", F.round("k", 6)).write.parquet(f"{tmp_path}/k")
    assert spark.read.parquet(f"{tmp_path}/k").count() == 500 * 4000
    assert sum(f.stat().st_size for f in (tmp_path / "k").glob("*.parquet")) < 6 * 500 * 4000


def test_kernel_of_a_large_block_is_whole_in_few_bytes(spark, tmp_path):
    import pyarrow.parquet as pq

    rng = np.random.default_rng(14)
    x = rng.normal(size=(16000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = spark.createDataFrame([(i, v.tobytes()) for i, v in enumerate(x)], "row_id bigint, v binary").mapInPandas(
        lambda parts: (p.assign(features=[np.frombuffer(v, np.float32) for v in p["v"]])[["row_id", "features"]] for p in parts), "row_id bigint, features array<float>"
    )
    svm.kernel_table(rows.where("row_id % 80 = 0"), rows, 0.5).withColumn("k", F.round("k", 6)).write.parquet(f"{tmp_path}/k")
    got = pq.read_table(f"{tmp_path}/k")
    a, b, k = (got[c].to_numpy() for c in "abk")
    assert len(got) == 200 * 16000 and len(np.unique(a * 16000 + b)) == len(got)
    want = np.exp(x[::80].astype(float) @ x.T.astype(float) - 1)
    assert np.abs(k - want[a // 80, b]).max() < 2e-6
    assert sum(f.stat().st_size for f in (tmp_path / "k").glob("*.parquet")) < 4.5 * len(got)


def test_kernel_shuffles_every_vector_once(spark, monkeypatch):
    for name, n in (("ASKED_ROWS", 16), ("KERNEL_ROWS", 40), ("SORTED_CELLS", 100), ("COMMON_VALUES", 5)):
        monkeypatch.setattr(svm, name, n, raising=False)
    rng = np.random.default_rng(15)
    x = rng.normal(size=(90, 3))
    x[3, 1], x[4, 0] = np.nan, np.inf
    ids = [*range(84), 7, 7, 9, 9, None, None]
    x[87] = x[86]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "row_id bigint, features array<double>")
    table = svm.kernel_table(rows.where("row_id < 50"), rows, 0.5)
    some = [i for i, n in enumerate(ids) if n is not None and n < 50]
    with np.errstate(invalid="ignore"):
        k = svm.kernel(x[some], x, 0.5)
    plain = lambda a, b, c: (a, -1 if b is None else b, f"{c:.6f}")
    assert sorted(plain(*r) for r in table.collect()) == sorted(plain(ids[i], b, c) for i, line in zip(some, k, strict=True) for b, c in zip(ids, line, strict=True))
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "Generate" not in plan and "Sort" not in plan


def test_product_of_all_cells(spark, sf_dir, points):
    got = {(r["i"], r["j"]): r["x"] for r in QUERIES["matmul_whole"](spark, sf_dir).collect()}
    want = points[1].T @ points[1]
    assert len(got) == want.size and all(abs(x - want[c]) < 2e-6 for c, x in got.items())


def test_cascade_ends_and_predicts_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(svm, "GROUP_ROWS", 40)
    monkeypatch.setattr(svm, "MOST_ROWS", 30)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] + x[:, 1] > 0).astype(int)
    rows = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, y, strict=True))], "row_id bigint, features array<double>, label int")
    calls = []
    layers = type(rows).checkpoint

    def counted(self, *a, **b):
        calls.append(1)
        assert len(calls) < 40, "the cascade doesn't end"
        return layers(self, *a, **b)

    monkeypatch.setattr(type(rows), "checkpoint", counted)
    model = svm.CascadeSVM(cascade_arity=4, gamma=4.0).fit(rows)
    kept = model.model.collect()
    assert 30 < len(kept) < 270
    monkeypatch.setattr(svm, "SHARD_ROWS", 20)
    monkeypatch.setattr(svm, "BLOCK_ROWS", 16)
    twice = rows.unionByName(rows.where("row_id = 7").withColumn("features", F.array(F.lit(-3.0), F.lit(-3.0))))
    score = (svm.kernel(np.vstack([x, [[-3.0, -3.0]]]), np.array([r["v"] for r in kept]), 4.0) + 1.0) @ np.array([r["w"] for r in kept])
    want = sorted(zip([*range(300), 7], score.argmax(axis=1).tolist(), strict=True))
    assert sorted((r["row_id"], r["prediction"]) for r in model.predict(twice).collect()) == want
    assert np.mean([k == y[i] for i, k in want]) > 0.9


def test_linear_machines_learn_side_by_side(spark, monkeypatch):
    import threading

    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(10)
    y = rng.integers(0, 4, 200)
    x = rng.normal(size=(200, 4)) + 4 * np.eye(4)[y]
    rows = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, y, strict=True))], "row_id bigint, features array<double>, label int")
    all_here, fit = threading.Barrier(4, timeout=60), LinearSVC._fit
    monkeypatch.setattr(LinearSVC, "_fit", lambda self, data: (all_here.wait(), fit(self, data))[1])
    model = svm.one_against_rest(rows)
    got = model.transform(rows.select("label", array_to_vector("features").alias("vec"))).collect()
    assert np.mean([r["label"] == r["prediction"] for r in got]) > 0.95


@pytest.mark.parametrize("name", ["runlog_sorted", "local_row_number"])
def test_rows_are_numbered_in_many_tasks(spark, sf_dir, name):
    changed = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        assert len({r["p"] for r in QUERIES[name](spark, sf_dir).withColumn("p", F.spark_partition_id()).collect()}) > 8
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
