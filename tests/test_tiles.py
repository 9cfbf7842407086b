"""Block matrices and the shared reduction against numpy."""

import numpy as np
import pytest

from quarry.operators import reduction
from quarry.operators.histogram import dense_partials
from quarry.operators.tiles import TiledMatrix


def _cells(spark, x):
    return spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in np.argwhere(x != 0)], "i bigint, j bigint, x double")


def _dense(matrix):
    out = np.zeros((matrix.rows, matrix.cols))
    seen = set()
    for r in matrix.cells().collect():
        assert (r["i"], r["j"]) not in seen
        seen.add((r["i"], r["j"]))
        out[r["i"], r["j"]] = r["x"]
    return out


@pytest.fixture(scope="module")
def pair(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(23, 17)), rng.normal(size=(17, 31))
    a[4:12, 8:16] = 0  # tiles that are missing
    b[:4] = 0
    return a, b, TiledMatrix.of_cells(_cells(spark, a), 23, 17, 4), TiledMatrix.of_cells(_cells(spark, b), 17, 31, 4)


def test_products_over_many_panels_and_depths(pair):
    a, b, x, y = pair
    for panel, deep in ((1, 1), (2, 2), (4, 8)):
        assert np.allclose(_dense(x.matmul(y, panel, deep)), a @ b)
    assert np.allclose(_dense(x.transpose().matmul(x)), a.T @ a)
    with pytest.raises(ValueError, match="shapes"):
        y.matmul(x.transpose().transpose().matmul(y))


def test_sum_transpose_scale_and_slices(pair):
    a, b, x, y = pair
    assert np.allclose(_dense(x.transpose()), a.T) and np.allclose(_dense(x.add(x.scale(2))), 3 * a)
    for r, c in (((0, 23), (0, 17)), ((3, 22), (5, 14)), ((8, 12), (4, 8)), ((1, 2), (16, 17)), ((22, 23), (0, 1)), ((5, 5), (0, 3))):
        assert np.allclose(_dense(x.slice(r, c)), a[slice(*r), slice(*c)])
    with pytest.raises(ValueError, match="outside"):
        x.slice((0, 24), (0, 1))
    with pytest.raises(ValueError, match="shapes"):
        x.add(y)


def test_rows_nulls_and_repeats(spark):
    rows = [(0, [1.0, 2.0, 3.0]), (2, [4.0, 5.0, 6.0]), (2, [1.0, 1.0, 1.0]), (3, None), (4, [None, 1.0, 1.0])]
    m = TiledMatrix.of_rows(spark.createDataFrame(rows, "row_id bigint, features array<double>"), rows=5, block=2)
    assert np.allclose(_dense(m), [[1, 2, 3], [0, 0, 0], [5, 6, 7], [0, 0, 0], [0, 0, 0]])
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0), (1, 1, None), (9, 9, 1.0), (None, 0, 1.0)], "i bigint, j bigint, x double")
    assert np.allclose(_dense(TiledMatrix.of_cells(cells, 2, 2, 1)), [[3, 0], [0, 0]])
    none = TiledMatrix.of_cells(cells.limit(0), 2, 2, 1)
    assert none.matmul(none).cells().count() == 0


@pytest.mark.parametrize(("lanes", "arity"), [(1, 48), (48, 48), (49, 48), (200, 3)])
def test_no_group_of_a_reduction_is_above_the_arity(spark, lanes, arity):
    rng = np.random.default_rng(lanes)
    x = rng.integers(0, 9, (lanes, 2, 5))
    parts = spark.createDataFrame([(k, i, [float(v) for v in x[i, k]]) for i in range(lanes) for k in range(2)], "k int, lane bigint, value array<double>")
    got = {r["k"]: r["value"] for r in reduction.sum_arrays(parts, ["k"], lanes, arity).collect()}
    assert got == {k: x[:, k].sum(axis=0).tolist() for k in range(2)}
    left = lanes
    for after in reduction.levels(lanes, arity):
        assert -(-left // after) <= arity
        left = after
    assert left == 1


def test_arrays_of_other_lengths_are_an_error(spark):
    parts = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "lane bigint, value array<double>")
    with pytest.raises(Exception, match="different lengths"):
        reduction.sum_arrays(parts, [], 2).collect()


def test_dense_histogram_edges(spark):
    values = [0.0, 0.25, 0.5, 0.999999, 1.0, -0.1, 1.1, float("nan")]
    rows = spark.createDataFrame([([v],) for v in values] + [(None,)], "features array<double>")
    assert reduction.sum_arrays(dense_partials(rows, [(0.0, 1.0)], 4), [], 64).first()["value"] == [1.0, 1.0, 1.0, 2.0]
