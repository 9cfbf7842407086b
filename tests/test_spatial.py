"""The spatial index against brute force."""

import numpy as np
import pytest

from quarry.operators import spatial
from quarry.sources import generate

DDL = "row_id bigint, features array<double>"


def _table(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(c) for c in r]) for i, r in zip(ids if ids is not None else range(len(x)), x, strict=True)], DDL)


def _brute(x, ids, q, k):
    dist = np.sqrt(((x - q) ** 2).sum(axis=1))
    order = np.lexsort((ids, dist))[:k]
    return [(int(ids[i]), round(float(dist[i]), 9)) for i in order]


def _got(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["neighbor_id"], round(r["dist"], 9)))
    return {q: [x[1:] for x in sorted(v)] for q, v in out.items()}


@pytest.mark.parametrize("case", ["uniform", "equal", "clustered", "one", "wide"])
def test_neighbours_equal_brute_force(spark, case, monkeypatch):
    monkeypatch.setattr(spatial, "MOST_QUERIES", 100)
    monkeypatch.setattr(spatial, "COPY_QUERIES", 30)
    rng = np.random.default_rng(4)
    x = rng.random((2000, {"one": 1, "wide": 24}.get(case, 3)))
    if case == "equal":
        x[::3] = x[0]  # a third of all rows are one point
        x[1::7] = np.round(x[1::7], 1)
    if case == "clustered":
        x[:1500] = 0.5 + 1e-6 * x[:1500]
    ids = rng.permutation(2000) * 3
    q = np.concatenate([x[::9], rng.random((50, x.shape[1])) * 3 - 1])
    index = spatial.SpatialIndex(7, cell_rows=32).fit(_table(spark, x, ids))
    got = _got(index.kneighbors(_table(spark, q)))
    assert got == {i: _brute(x, ids, q[i], 7) for i in range(len(q))}
    if case in ("uniform", "one"):
        assert index.pairs_visited() < 0.25 * len(x) * len(q)


def test_fit_rows_stay_where_they_are_and_can_be_asked_again(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.random((3000, 3))
    index = spatial.SpatialIndex(4, cell_rows=100).fit(_table(spark, x))
    one = _got(index.kneighbors(_table(spark, x[:200])))
    index.save(f"{tmp_path}/model", spark)
    again = spatial.SpatialIndex.load(f"{tmp_path}/model", spark)
    assert _got(again.kneighbors(_table(spark, x[:200]))) == one
    for i in (index, again):
        asked = spark.createDataFrame([(1, 2, [0.5, 0.5, 0.5], 3)], "id bigint, h bigint, v array<double>, cell int")
        plan = i._met(i.cells(spark), asked, 4)._jdf.queryExecution().executedPlan().toString()
        fit_side = plan[plan.index("FlatMapCoGroupsInArrow") : plan.index("FileScan")]
        assert "Exchange" not in fit_side and "Bucketed: true" in plan, plan
        assert plan.count("Exchange") == 1
    index.drop(spark)
    with pytest.raises(ValueError, match="not fitted"):
        index.kneighbors(_table(spark, x[:2]))


def test_a_tenth_of_all_pairs_is_enough(spark):
    points = generate.random_points(spark, 100_000, 3, seed=1).persist()
    asked = generate.random_points(spark, 100_000, 3, seed=2).persist()
    index = spatial.SpatialIndex(5).fit(points)
    got = {}
    for r in index.kneighbors(asked).where("query_id % 5000 = 0").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["neighbor_id"]))
    rows = np.array([r["features"] for r in points.orderBy("row_id").collect()])
    for r in asked.where("row_id % 5000 = 0").collect():
        want = _brute(rows, np.arange(len(rows)), np.array(r["features"]), 5)
        assert [n for _, n in sorted(got[r["row_id"]])] == [i for i, _ in want]
    assert index.pairs_visited() < 0.1 * 100_000 * 100_000
    points.unpersist(), asked.unpersist()


def test_nulls_lengths_repeated_ids_and_none(spark):
    rows = [(1, [0.0, 0.0]), (1, [1.0, 1.0]), (2, None), (3, [None, 1.0]), (4, [5.0, 5.0])]
    fit = spark.createDataFrame(rows, DDL)
    index = spatial.SpatialIndex(2).fit(fit)
    got = sorted(tuple(r) for r in index.kneighbors(fit.union(fit)).collect())
    d = 2**0.5
    assert [(q, r, n) for q, r, n, _ in got] == [(1, 1, 1), (1, 1, 1), (1, 2, 1), (1, 2, 1), (4, 1, 4), (4, 2, 1)] and got[2][3] == pytest.approx(d)
    with pytest.raises(ValueError, match="fewer than"):
        index.kneighbors(fit, 9)
    with pytest.raises(ValueError, match="not fitted"):
        spatial.SpatialIndex().kneighbors(fit)
    with pytest.raises(ValueError, match="dimensions"):
        index.kneighbors(spark.createDataFrame([(1, [1.0])], DDL))
    with pytest.raises(ValueError, match="no points"):
        spatial.SpatialIndex().fit(fit.limit(0))
    assert index.kneighbors(fit.limit(0)).count() == 0
    with pytest.raises(Exception, match="different lengths"):
        spatial.SpatialIndex(1).fit(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, [1.0, 3.0])], DDL))


@pytest.mark.parametrize("parts", [1, 3])
def test_the_way_down_takes_bounded_memory(monkeypatch, parts):
    """1,000 queries that no box of 256 leaves can turn away, in 64 dimensions: 16 million numbers at once otherwise."""
    monkeypatch.setattr(spatial, "MOST_NUMBERS", 1 << 16, raising=False)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2000, 64))
    tree = spatial.Tree.of_sample(x, 256)
    cells = np.arange(256 * parts)
    low = np.repeat(np.array([x[tree.leaf(x) == c].min(axis=0) for c in range(256)]), parts, axis=0)
    tree = spatial.Tree(tree.axes, tree.cuts, np.full(256, parts), low, low + 1)
    seen, away = [], spatial.Tree._away
    monkeypatch.setattr(spatial.Tree, "_away", staticmethod(lambda q, a, b: seen.append(q.size) or away(q, a, b)))
    far = tree.within(x[:1000], np.full(1000, np.inf))
    pieces = [far] if isinstance(far, tuple) else list(far)
    assert max(seen) <= 1 << 16
    query, cell = (np.concatenate(c) for c in zip(*pieces, strict=True))
    assert sorted(zip(query.tolist(), cell.tolist(), strict=True)) == [(q, c) for q in range(1000) for c in cells]
    near = np.array([away(np.repeat(q[None], len(low), axis=0), low, low + 1) for q in x[:50]])
    found = list(tree.within(x[:50], np.full(50, np.median(near))))
    assert {(q, c) for a, b in found for q, c in zip(a.tolist(), b.tolist(), strict=True)} == {(q, c) for q, c in zip(*np.nonzero(near <= np.median(near)), strict=True)}
