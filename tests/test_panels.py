"""The SVD on stored column panels against numpy."""

import numpy as np
import pytest

from quarry.operators import panels
from quarry.operators.tiles import TiledMatrix


def _tiled(spark, x, block):
    cells = [(int(i), int(j), float(x[i, j])) for i, j in np.argwhere(x != 0)]
    return TiledMatrix.of_cells(spark.createDataFrame(cells, "i bigint, j bigint, x double"), *x.shape, block)


def _dense(m):
    out = np.zeros((m.rows, m.cols))
    for r in m.cells().collect():
        out[r["i"], r["j"]] = r["x"]
    return out


def _holds(x, u, s, v, sort=False):
    s = np.array([r["s"] for r in s.orderBy("j").collect()])
    u, v = _dense(u), _dense(v)
    want = np.linalg.svd(x)[1]
    want = np.concatenate([want, np.zeros(x.shape[1] - len(want))])
    assert np.allclose(np.sort(s)[::-1], want, atol=1e-9 * want[0])
    assert np.allclose(u @ np.diag(s) @ v.T, x, atol=1e-9 * want[0]) and np.allclose(v.T @ v, np.eye(x.shape[1]), atol=1e-9)
    some = s > 1e-9 * want[0]
    assert np.allclose((u.T @ u)[np.ix_(some, some)], np.eye(int(some.sum())), atol=1e-8)
    assert not sort or (np.diff(s) <= 1e-12).all()


@pytest.mark.parametrize(("shape", "block", "options"), [((40, 12), 4, {}), ((9, 14), 5, {"randomize_pairings": True}), ((7, 3), 8, {"sort": True}), ((30, 10), 4, {"sort": True, "randomize_pairings": True, "seed": 3})])
def test_equals_numpy(spark, shape, block, options):
    x = np.random.default_rng(sum(shape)).normal(size=shape)
    x[:, 1] = x[:, 0]  # rank is not full
    _holds(x, *panels.svd(_tiled(spark, x, block), **options), sort=options.get("sort", False))


def test_iterations_can_be_limited(spark):
    x = np.random.default_rng(3).normal(size=(30, 8))
    off = []
    for n in (1, 2, 8):
        u, _, _ = panels.svd(_tiled(spark, x, 4 if n == 8 else 2), max_iterations=n)
        g = _dense(u)
        off.append(np.abs(g.T @ g - np.eye(8)).max())
    assert off[0] > off[1] > off[2] and off[2] < 1e-9


def test_more_than_4096_columns(spark):
    """A sparse case: only tiles with cells are stored, and columns of far panels are coupled."""
    n, rng = 4200, np.random.default_rng(6)
    cells = {(i, i): float(1 + i % 7) for i in range(0, n, 5)}
    for i in range(0, n, 700):
        cells[i, (i + 2100) % n] = float(rng.normal())
    matrix = TiledMatrix.of_cells(spark.createDataFrame([(i, j, x) for (i, j), x in cells.items()], "i bigint, j bigint, x double"), n, n, 1050)
    u, s, v = panels.svd(matrix, max_iterations=4)
    rows, cols = sorted({i for i, _ in cells}), sorted({j for _, j in cells})
    x = np.zeros((len(rows), len(cols)))
    for (i, j), c in cells.items():
        x[rows.index(i), cols.index(j)] = c
    want = np.sort(np.linalg.svd(x)[1])
    got = np.sort([r["s"] for r in s.where("s > 0").collect()])
    assert np.allclose(got[-len(want) :], want, atol=1e-9) and s.count() == n
    assert u.cells().where("x <> 0").count() < 4 * len(cells) and v.cells().where("x <> 0").count() < n + 4 * len(cells)
