"""Singular values of wide matrices: one-sided block Jacobi on stored column panels.

The matrix and V are tables of tiles; a panel is a column of tiles. In each round of a sweep every panel meets one
other: a shuffle keyed by (pair, rows) brings the tiles of the two panels that lie beside each other together,
TALL rows of tiles a group. Tasks take their groups' Gram matrices, which the shared reduction adds up by
pair; the eigenvectors of a pair's Gram matrix are found in a task, too, and joined to the pair's tiles, which other tasks
turn by them while they deal the tiles to the pairs of the next round. Nothing that grows with the matrix passes through the
driver: it only learns how many pairs were turned. Each round's tiles are written to the shared folder, those of the round before deleted.

Sweeps end when no pair was turned, or after max_iterations. randomize_pairings draws the panels' places and the order of
rounds anew each sweep, from the seed. Singular values are not sorted unless asked for.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.tables import forget, written
from quarry.operators.matrix import TINY, pair_rotation, rounds_of
from quarry.operators.reduction import sum_arrays
from quarry.operators.tiles import TiledMatrix

TALL = 8
LANES = 2304
_STATE = "kind int, rb int, cb int, tile array<double>"
_PAIRED = "pair int, kind int, lane bigint, rb int, a int, b int, left array<double>, right array<double>"
_VECTOR = pa.list_(pa.float64())


class _Shape:
    """What tasks must know of the tiles' sizes."""

    def __init__(self, rows: int, cols: int, block: int):
        self.rows, self.cols, self.block = rows, cols, block

    def of(self, kind: int, rb: int, cb: int) -> tuple[int, int]:
        tall = self.cols if kind else self.rows
        return min(self.block, tall - rb * self.block), min(self.block, self.cols - cb * self.block)

    def tile(self, values, kind: int, rb: int, cb: int) -> np.ndarray:
        size = self.of(kind, rb, cb)
        return np.zeros(size) if values is None or not len(values) else np.asarray(values.values if isinstance(values, pa.ListScalar) else values).reshape(size)


def _place(values: list[int]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cb") + 1)


def _paired(state: DataFrame, pairs: list[tuple[int, int]], panels: int, shape: _Shape) -> DataFrame:
    """The tiles of each pair side by side; a panel that sits a round out is a pair of its own."""
    pairs = [*pairs, *((p, -1) for p in range(panels) if all(p not in pair for pair in pairs))]
    number, left = [0] * panels, [0] * panels
    for n, (a, b) in enumerate(pairs):
        for panel in (a, b):
            if panel >= 0:
                number[panel], left[panel] = n, int(panel == a)
    keyed = state.select(_place(number).alias("pair"), "kind", F.floor(F.col("rb") / TALL).cast("bigint").alias("lane"), "rb", "cb", _place(left).alias("is_left"), "tile")

    def side_by_side(group: pa.Table) -> pa.Table:
        a, b = pairs[group["pair"][0].as_py()]
        kind, lane = group["kind"][0].as_py(), group["lane"][0].as_py()
        tiles = {(rb, cb): t for rb, cb, t in zip(group["rb"].to_pylist(), group["cb"].to_pylist(), group["tile"], strict=True)}
        at = sorted({rb for rb, _ in tiles})
        side = {p: [shape.tile(tiles.get((rb, p)), kind, rb, p).ravel() if p >= 0 else np.zeros(0) for rb in at] for p in (a, b)}
        n = len(at)
        return pa.table({"pair": pa.array([group["pair"][0].as_py()] * n, pa.int32()), "kind": pa.array([kind] * n, pa.int32()), "lane": pa.array([lane] * n, pa.int64()), "rb": pa.array(at, pa.int32()), "a": pa.array([a] * n, pa.int32()), "b": pa.array([b] * n, pa.int32()), "left": pa.array(side[a], _VECTOR), "right": pa.array(side[b], _VECTOR)})

    return keyed.groupBy("pair", "kind", "lane").applyInArrow(side_by_side, _PAIRED)


def _rotations(paired: DataFrame, lanes: int, shape: _Shape, scale: float, eps: float) -> DataFrame:
    """pair, turn: the rotation of each pair that is not orthogonal yet, found in tasks."""
    held = min(lanes, LANES)

    def partial(batches):
        total = {}
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(5)), batch.column(5), batch.column(6), strict=True)
            for pair, lane, rb, a, b, left, right in rows:
                if b >= 0:
                    x = np.concatenate([shape.tile(left, 0, rb, a), shape.tile(right, 0, rb, b)], axis=1)
                    key = pair, lane % held
                    total[key] = total[key] + x.T @ x if key in total else x.T @ x
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in total], pa.int32()), pa.array([lane for _, lane in total], pa.int64()), pa.array([t.ravel() for t in total.values()], _VECTOR)], names=["pair", "lane", "value"])

    def turn(batches):
        for batch in batches:
            out = []
            for pair, gram in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                g = np.asarray(gram.values)
                n = math.isqrt(len(g))
                q = pair_rotation(g.reshape(n, n), scale, eps)
                if q is not None:
                    out.append((pair, q.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([q for _, q in out], _VECTOR)], names=["turned", "turn"])

    rows = paired.where("kind = 0").select("pair", "lane", "rb", "a", "b", "left", "right")
    # A task's sums for one pair and lane may meet those of others: they are added up with the lane's.
    grams = sum_arrays(rows.mapInArrow(partial, "pair int, lane bigint, value array<double>"), ["pair"], held)
    return grams.select("pair", "value").mapInArrow(turn, "turned int, turn array<double>")


def _turned(paired: DataFrame, turns: DataFrame, shape: _Shape) -> DataFrame:
    """The tiles of all pairs, turned where there is a rotation."""

    def run(batches):
        for batch in batches:
            kinds, rbs, tiles = [], [], []
            cbs = []
            for kind, rb, a, b, left, right, q in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), batch.column(5), batch.column(6), strict=True):
                x = shape.tile(left, kind, rb, a)
                y = shape.tile(right, kind, rb, b) if b >= 0 else None
                if q.is_valid:
                    both = np.concatenate([x, y], axis=1) @ np.asarray(q.values).reshape(x.shape[1] + y.shape[1], -1)
                    x, y = both[:, : x.shape[1]], both[:, x.shape[1] :]
                for cb, t in ((a, x), (b, y)):
                    if t is not None and t.any():
                        kinds.append(kind), rbs.append(rb), cbs.append(cb), tiles.append(t.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(rbs, pa.int32()), pa.array(cbs, pa.int32()), pa.array(tiles, _VECTOR)], names=["kind", "rb", "cb", "tile"])

    joined = paired.join(turns, F.col("pair") == F.col("turned"), "left")
    return joined.select("kind", "rb", "a", "b", "left", "right", "turn").mapInArrow(run, _STATE)


def _identity(matrix: TiledMatrix) -> DataFrame:
    n, cols = matrix.block, matrix.cols
    size = F.least(F.lit(n), F.lit(cols) - F.col("id") * n).cast("int")
    tile = F.flatten(F.transform(F.sequence(F.lit(0), size - 1), lambda r: F.transform(F.sequence(F.lit(0), size - 1), lambda c: F.when(r == c, 1.0).otherwise(0.0))))
    return matrix.tiles.sparkSession.range(math.ceil(cols / n)).select(F.lit(1).alias("kind"), F.col("id").cast("int").alias("rb"), F.col("id").cast("int").alias("cb"), tile.alias("tile"))


def svd(matrix: TiledMatrix, sort: bool = False, eps: float = 1e-12, max_iterations: int = 30, randomize_pairings: bool = False, seed: int = 42) -> tuple[TiledMatrix, DataFrame, TiledMatrix]:
    """(u, s, v) with a = u diag(s) v': u and v as tiles, s as a table (j, s). A zero singular value's column of u is zero.

    sort puts the columns in order of falling singular values, which moves single columns and so goes through cells.
    """
    if not matrix.rows or not matrix.cols:
        raise ValueError("no rows")
    shape, panels = _Shape(matrix.rows, matrix.cols, matrix.block), math.ceil(matrix.cols / matrix.block)
    lanes = math.ceil(math.ceil(matrix.rows / matrix.block) / TALL)
    state = matrix.tiles.select(F.lit(0).alias("kind"), "rb", "cb", "tile").unionByName(_identity(matrix))
    state = written(state, "panels")
    squares = F.aggregate("tile", F.lit(0.0), lambda s, x: s + x * x)
    scale = state.where("kind = 0").agg(F.sum(squares)).first()[0] or 0.0
    rng, held = np.random.default_rng(seed), [state]
    for _ in range(max_iterations):
        moved, rounds = 0, rounds_of(panels) or [[]]
        if randomize_pairings:
            label = rng.permutation(panels).tolist()
            rounds = [[tuple(sorted((label[a], label[b]))) for a, b in rounds[i]] for i in rng.permutation(len(rounds))]
        if panels == 1:
            return _one_panel(matrix, state, shape, scale, eps, sort)
        for pairs in rounds:
            paired = written(_paired(state, pairs, panels, shape), "paired")
            turns = written(_rotations(paired, lanes, shape, scale, eps), "turns")
            moved += turns.count()
            state = _turned(paired, turns, shape)
            for old in held:
                forget(old)
            held = [paired, turns]
        if not moved:
            break
    return _parts(matrix, written(state, "panels"), scale, sort)


def _one_panel(matrix: TiledMatrix, state: DataFrame, shape: _Shape, scale: float, eps: float, sort: bool):
    """A single panel meets a panel of no columns: one rotation settles it."""
    tiles = state.where("kind = 0").select(F.lit(0).alias("pair"), F.floor(F.col("rb") / TALL).cast("bigint").alias("lane"), F.col("tile").alias("value"), "rb")
    n = matrix.cols

    def partial(batches):
        total, met = np.zeros((n, n)), False
        for batch in batches:
            for rb, tile in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x, met = shape.tile(tile, 0, rb, 0), True
                total += x.T @ x
        if met:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([total.ravel()], _VECTOR)], names=["lane", "value"])

    gram = sum_arrays(tiles.select("rb", "value").mapInArrow(partial, "lane bigint, value array<double>"), [], 1).first()
    q = pair_rotation(np.array(gram["value"]).reshape(n, n), scale, eps) if gram else None
    turn = (np.eye(n) if q is None else q).ravel().tolist()

    def run(batches):
        for batch in batches:
            made = [(shape.tile(t, k, rb, 0) @ np.array(turn).reshape(n, n)).ravel() for k, rb, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, _VECTOR)], names=["kind", "rb", "cb", "tile"])

    return _parts(matrix, written(state.select("kind", "rb", "cb", "tile").mapInArrow(run, _STATE), "panels"), scale, sort)


def _parts(matrix: TiledMatrix, state: DataFrame, scale: float, sort: bool):
    a = TiledMatrix(state.where("kind = 0").select("rb", "cb", "tile"), matrix.rows, matrix.cols, matrix.block)
    v = TiledMatrix(state.where("kind = 1").select("rb", "cb", "tile"), matrix.cols, matrix.cols, matrix.block)
    norms = a.cells().groupBy("j").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("s"))
    every = state.sparkSession.range(matrix.cols).select(F.col("id").alias("j")).join(norms, "j", "left").select("j", F.coalesce("s", F.lit(0.0)).alias("s"))
    every = written(every, "singular")
    some = every.where(F.col("s") > TINY * math.sqrt(scale))
    if sort:  # one number a column decides its place
        order = {r["j"]: i for i, r in enumerate(every.orderBy(F.desc("s"), "j").collect())}
        place = state.sparkSession.createDataFrame(sorted(order.items()), "j bigint, at bigint")
        every = every.join(place, "j").select(F.col("at").alias("j"), "s")
        moved = a.cells().join(some, "j").join(place, "j").select("i", F.col("at").alias("j"), (F.col("x") / F.col("s")).alias("x"))
        u = TiledMatrix.of_cells(moved, matrix.rows, matrix.cols, matrix.block)
        v = TiledMatrix.of_cells(v.cells().join(place, "j").select("i", F.col("at").alias("j"), "x"), matrix.cols, matrix.cols, matrix.block)
        return u, every, v
    n = matrix.block
    by = every.select(F.floor(F.col("j") / n).cast("int").alias("cb"), F.struct((F.col("j") % n).alias("c"), F.when(F.col("s") > TINY * math.sqrt(scale), 1 / F.col("s")).otherwise(0.0).alias("by")).alias("p"))
    by = by.groupBy("cb").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["by"]).alias("by"))
    width = F.size("by")
    tile = F.transform("tile", lambda x, i: x * F.get("by", i % width))
    return TiledMatrix(a.tiles.join(by, "cb").select("rb", "cb", tile.alias("tile")), matrix.rows, matrix.cols, n), every, v
