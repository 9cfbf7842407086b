"""Block matrices: rows (rb, cb, tile), each a dense row-major block of ``block`` x ``block`` cells, the last of a row or column smaller.

Tiles of zeros only may be missing. Products replicate each tile of the left matrix to the column panels and each of
the right one to the row panels of a grid of PANEL x PANEL tiles, cut into DEEP tiles of the inner index: a group
multiplies these, at most 2 * PANEL * DEEP tiles in and PANEL * PANEL out, and the groups' partial tiles
are added up by the shared reduction. So neither a long row of tiles nor a whole matrix is one task's.
"""

from __future__ import annotations

import dataclasses
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.vector import uniform
from quarry.operators.reduction import sum_arrays

BLOCK = 256
PANEL = 4
DEEP = 8
_TILE = "rb int, cb int, tile array<double>"
_VECTOR = pa.list_(pa.float64())


def _table(rb: list, cb: list, tiles: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rb, pa.int32()), pa.array(cb, pa.int32()), pa.array([t.ravel() for t in tiles], _VECTOR)], names=["rb", "cb", "tile"])


def _numbers(n: int):
    return F.sequence(F.lit(0).cast("bigint"), F.lit(max(0, n - 1)).cast("bigint"))


@dataclasses.dataclass(frozen=True)
class TiledMatrix:
    tiles: DataFrame  # rb, cb, tile
    rows: int
    cols: int
    block: int

    def height(self, rb: int) -> int:
        return min(self.block, self.rows - rb * self.block)

    def width(self, cb: int) -> int:
        return min(self.block, self.cols - cb * self.block)

    @staticmethod
    def of_cells(cells: DataFrame, rows: int, cols: int, block: int = BLOCK) -> TiledMatrix:
        """Of cells (i, j, x), whose missing ones are zero and repeated ones add up. Null cells take no part."""
        n = block
        inside = (F.col("i").between(0, rows - 1)) & (F.col("j").between(0, cols - 1))
        placed = cells.where(inside & F.col("x").isNotNull()).select(
            F.floor(F.col("i") / n).cast("int").alias("rb"), F.floor(F.col("j") / n).cast("int").alias("cb"), (F.col("i") % n).cast("int").alias("r"), (F.col("j") % n).cast("int").alias("c"), F.col("x").cast("double").alias("x")
        )
        placed = placed.groupBy("rb", "cb", "r", "c").agg(F.sum("x").alias("x"))

        def fill(group: pa.Table) -> pa.Table:
            rb, cb = group["rb"][0].as_py(), group["cb"][0].as_py()
            tile = np.zeros((min(n, rows - rb * n), min(n, cols - cb * n)))
            tile[group["r"].to_numpy(), group["c"].to_numpy()] = group["x"].to_numpy()
            return pa.Table.from_batches([_table([rb], [cb], [tile])])

        return TiledMatrix(placed.groupBy("rb", "cb").applyInArrow(fill, _TILE), rows, cols, block)

    @staticmethod
    def of_rows(points: DataFrame, rows: int | None = None, block: int = BLOCK, row_id: str = "row_id", features: str = "features") -> TiledMatrix:
        """Of rows (row_id, features) with ids 0 .. rows - 1; a tile's group is ``block`` pieces of rows. Missing rows are zero."""
        points, cols = uniform(points.select(F.col(row_id).cast("bigint").alias("i"), F.col(features).alias("v")), "v")
        rows = (points.agg(F.max("i")).first()[0] or -1) + 1 if rows is None else rows
        n = block
        pieces = F.transform(F.sequence(F.lit(0), F.lit(max(0, math.ceil(cols / n) - 1))), lambda b: F.struct(b.alias("cb"), F.slice("v", b * n + 1, F.lit(n)).alias("piece")))
        cut = points.where(F.col("i").between(0, rows - 1)).select(F.floor(F.col("i") / n).cast("int").alias("rb"), (F.col("i") % n).cast("int").alias("r"), F.explode(pieces).alias("p"))

        def fill(group: pa.Table) -> pa.Table:
            rb, cb = group["rb"][0].as_py(), group["cb"][0].as_py()
            x = np.asarray(group["piece"].combine_chunks().flatten()).reshape(group.num_rows, -1)
            tile = np.zeros((min(n, rows - rb * n), x.shape[1]))
            np.add.at(tile, group["r"].to_numpy(), x)
            return pa.Table.from_batches([_table([rb], [cb], [tile])])

        return TiledMatrix(cut.select("rb", "p.cb", "r", "p.piece").groupBy("rb", "cb").applyInArrow(fill, _TILE), rows, cols, block)

    def cells(self) -> DataFrame:
        """i, j, x of all cells of the tiles there are."""
        width = F.least(F.lit(self.block), F.lit(self.cols) - F.col("cb") * self.block)
        flat = self.tiles.select("rb", "cb", width.alias("w"), F.posexplode("tile").alias("at", "x"))
        row = F.col("rb").cast("bigint") * self.block + F.floor(F.col("at") / F.col("w"))
        return flat.select(row.cast("bigint").alias("i"), (F.col("cb").cast("bigint") * self.block + F.col("at") % F.col("w")).alias("j"), "x")

    def _mapped(self, f, rows: int, cols: int) -> TiledMatrix:
        """f(rb, cb, matrix) gives (rb, cb, matrix) triples."""
        tall, wide, n = self.rows, self.cols, self.block

        def run(batches):
            for batch in batches:
                for rb, cb, tile in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    matrix = np.asarray(tile.values).reshape(min(n, tall - rb * n), min(n, wide - cb * n))
                    out = list(f(rb, cb, matrix))
                    if out:
                        yield _table(*(list(x) for x in zip(*out, strict=True)))

        return TiledMatrix(self.tiles.select("rb", "cb", "tile").mapInArrow(run, _TILE), rows, cols, n)

    def transpose(self) -> TiledMatrix:
        return self._mapped(lambda rb, cb, x: [(cb, rb, np.ascontiguousarray(x.T))], self.cols, self.rows)

    def scale(self, by: float) -> TiledMatrix:
        return dataclasses.replace(self, tiles=self.tiles.withColumn("tile", F.transform("tile", lambda x: x * F.lit(float(by)))))

    def add(self, other: TiledMatrix) -> TiledMatrix:
        """Tiles meet by an equi-join on their place; one that is missing is zero."""
        self._same(other)
        both = self.tiles.join(other.tiles.withColumnRenamed("tile", "more"), ["rb", "cb"], "full")
        total = F.when(F.col("tile").isNull(), F.col("more")).when(F.col("more").isNull(), F.col("tile")).otherwise(F.zip_with("tile", "more", lambda a, b: a + b))
        return dataclasses.replace(self, tiles=both.select("rb", "cb", total.alias("tile")))

    def _same(self, other: TiledMatrix) -> None:
        if (self.rows, self.cols, self.block) != (other.rows, other.cols, other.block):
            raise ValueError(f"shapes differ: {self.rows} x {self.cols} by {self.block}, {other.rows} x {other.cols} by {other.block}")

    def slice(self, rows: tuple[int, int], cols: tuple[int, int]) -> TiledMatrix:
        """The cells of two half-open ranges: tiles outside are not read on, the others cut, and pieces of a new tile put together."""
        (r0, r1), (c0, c1), n = rows, cols, self.block
        if not (0 <= r0 <= r1 <= self.rows and 0 <= c0 <= c1 <= self.cols):
            raise ValueError("ranges outside the matrix")
        tall, wide = r1 - r0, c1 - c0
        met = self.tiles.where((F.col("rb") * n < r1) & ((F.col("rb") + 1) * n > r0) & (F.col("cb") * n < c1) & ((F.col("cb") + 1) * n > c0))

        def cut(rb, cb, x):
            for nr in range(max(0, (rb * n - r0) // n), min(-(-tall // n), ((rb + 1) * n - 1 - r0) // n + 1)):
                for nc in range(max(0, (cb * n - c0) // n), min(-(-wide // n), ((cb + 1) * n - 1 - c0) // n + 1)):
                    piece = np.zeros((min(n, tall - nr * n), min(n, wide - nc * n)))
                    top, left = nr * n + r0, nc * n + c0  # in the old matrix
                    a, b = max(top, rb * n), min(top + piece.shape[0], rb * n + x.shape[0])
                    c, d = max(left, cb * n), min(left + piece.shape[1], cb * n + x.shape[1])
                    if a < b and c < d:
                        piece[a - top : b - top, c - left : d - left] = x[a - rb * n : b - rb * n, c - cb * n : d - cb * n]
                        yield nr, nc, piece

        pieces = dataclasses.replace(self, tiles=met)._mapped(cut, self.rows, self.cols).tiles
        lane = F.row_number().over(Window.partitionBy("rb", "cb").orderBy(F.lit(0))) - 1  # four pieces a tile at most
        return TiledMatrix(sum_arrays(pieces.select("rb", "cb", lane.alias("lane"), F.col("tile").alias("value")), ["rb", "cb"], 4).withColumnRenamed("value", "tile"), tall, wide, n)

    def matmul(self, other: TiledMatrix, panel: int = PANEL, deep: int = DEEP) -> TiledMatrix:
        if self.cols != other.rows or self.block != other.block:
            raise ValueError(f"shapes don't fit: {self.rows} x {self.cols} by {self.block}, {other.rows} x {other.cols} by {other.block}")
        n, rows, inner, cols = self.block, self.rows, self.cols, other.cols
        down, across = math.ceil(math.ceil(rows / n) / panel), math.ceil(math.ceil(cols / n) / panel)
        left = self.tiles.select(F.floor(F.col("rb") / panel).alias("gr"), F.explode(_numbers(across)).alias("gc"), F.floor(F.col("cb") / deep).alias("lane"), F.col("rb").alias("a"), F.col("cb").alias("k"), "tile")
        right = other.tiles.select(F.explode(_numbers(down)).alias("gr"), F.floor(F.col("cb") / panel).alias("gc"), F.floor(F.col("rb") / deep).alias("lane"), F.col("rb").alias("k"), F.col("cb").alias("b"), "tile")

        def multiply(x: pa.Table, y: pa.Table) -> pa.Table:
            def read(t, at, tall, wide):
                out = {}
                for p, k, tile in zip(t[at].to_pylist(), t["k"].to_pylist(), t["tile"], strict=True):
                    r, c = (p, k) if at == "a" else (k, p)
                    out.setdefault(k, []).append((p, np.asarray(tile.values).reshape(min(n, tall - r * n), min(n, wide - c * n))))
                return out

            one, two, total = read(x, "a", rows, inner), read(y, "b", inner, cols), {}
            for k in one.keys() & two.keys():
                for a, p in one[k]:
                    for b, q in two[k]:
                        total[a, b] = total[a, b] + p @ q if (a, b) in total else p @ q
            place = sorted(total)
            lane = x["lane"][0].as_py() if x.num_rows else 0
            made = _table([a for a, _ in place], [b for _, b in place], [total[p] for p in place])
            return pa.table({"rb": made["rb"], "cb": made["cb"], "lane": pa.array([lane] * len(place), pa.int64()), "value": made["tile"]})

        keys = ["gr", "gc", "lane"]
        parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(multiply, "rb int, cb int, lane bigint, value array<double>")
        lanes = math.ceil(math.ceil(inner / n) / deep)
        return TiledMatrix(sum_arrays(parts, ["rb", "cb"], lanes).withColumnRenamed("value", "tile"), rows, cols, n)
