"""Bootstrap intervals and binned densities against brute force."""

import numpy as np

from quarry.functions.random import uniform_matrix
from quarry.operators.resample import POISSON, binned_density, bootstrap_means


def test_bootstrap_equals_weights_drawn_one_by_one(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "ab"[i % 3 == 0], float(x)) for i, x in enumerate(rng.normal(5, 2, 900))] + [(1000, None, 1.0), (1001, "a", None), (1002, "a", float("nan")), (None, "a", 1.0)]
    df = spark.createDataFrame(rows, "id bigint, g string, v double").repartition(7)
    got = {r["g"]: r for r in bootstrap_means(df, ["g"], "v", "id", 80).collect()}
    assert set(got) == {"a", "b"}
    for g, r in got.items():
        ids = np.array([i for i, k, _ in rows[:900] if k == g])
        v = np.array([x for _, k, x in rows[:900] if k == g])
        w = np.searchsorted(POISSON, uniform_matrix(ids, 80), side="right")
        means = (w * v[:, None]).sum(axis=0) / w.sum(axis=0)
        assert r["n"] == len(v) and np.isclose(r["mean"], v.mean())
        assert np.allclose([r["lo"], r["hi"]], np.percentile(means, [2.5, 97.5]))
        error = v.std() / np.sqrt(len(v))
        assert 1.3 * error < (r["hi"] - r["lo"]) / 2 < 2.6 * error


def test_intervals_cover_the_mean(spark):
    """Of 200 groups of 60 rows about 95 % hold the true mean."""
    rng = np.random.default_rng(2)
    rows = [(g * 60 + i, g, float(x)) for g in range(200) for i, x in enumerate(rng.normal(3, 1, 60))]
    got = bootstrap_means(spark.createDataFrame(rows, "id bigint, g int, v double"), ["g"], "v", "id", 300).collect()
    assert len(got) == 200 and 0.88 <= np.mean([r["lo"] <= 3 <= r["hi"] for r in got]) <= 0.99


def test_density_is_near_the_kernel_over_all_rows(spark):
    rng = np.random.default_rng(3)
    values = {"a": np.concatenate([rng.normal(0, 1, 400), rng.normal(6, 0.5, 300)]), "b": rng.exponential(2, 500)}
    rows = [(g, float(x)) for g, v in values.items() for x in v] + [("one", 1.0), ("flat", 2.0), ("flat", 2.0), (None, 3.0), ("a", None)]
    got = {}
    for r in binned_density(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect():
        got.setdefault(r["g"], []).append((r["at"], r["x"], r["density"]))
    assert set(got) == {"a", "b"}
    for g, v in values.items():
        h = 0.1 * v.std(ddof=1)
        x, density = np.array(sorted(got[g]))[:, 1:].T
        want = np.exp(-0.5 * ((x[:, None] - v[None]) / h) ** 2).sum(axis=1) / (len(v) * h * np.sqrt(2 * np.pi))
        assert len(x) == 64 and np.abs(density - want).max() < 0.01 * want.max()
        assert np.isclose(x[0], v.min() - 3 * h) and np.isclose(x[-1], v.max() + 3 * h)


def test_no_rows(spark):
    none = spark.createDataFrame([], "id bigint, g string, v double")
    assert bootstrap_means(none, ["g"], "v", "id").collect() == [] and binned_density(none, ["g"], "v").collect() == []
