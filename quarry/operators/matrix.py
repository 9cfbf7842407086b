"""Matrices as row tables (row_id, features) or coordinates (i, j, x): norms, products, SVD.

svd() takes row tables of a bounded width, as one width-by-width Gram matrix comes to the driver; tasks
send one each, summed by a shuffle on Gram rows. panel_svd() takes wider ones: a one-sided block Jacobi
method on column panels, of which only the Gram blocks of a round's pairs leave the rows. Coordinate
operators have no such bound.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.tables import kept
from quarry.functions.vector import batch_matrix, checked, uniform
from quarry.operators.reduction import lanes_of, sum_arrays

MOST_COLUMNS = 4096
MOST_BYTES = 256_000_000
HELD_ROUNDS = 8
TINY = 1e-14


def coordinates(rows: DataFrame, row_id: str = "row_id", features: str = "features") -> DataFrame:
    return rows.select(F.col(row_id).alias("i"), F.posexplode(F.col(features).cast("array<double>")).alias("j", "x"))


def transpose(cells: DataFrame) -> DataFrame:
    return cells.select(F.col("j").alias("i"), F.col("i").alias("j"), "x")


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of coordinate matrices: joined on the inner index and summed."""
    return a.select("i", F.col("j").alias("k"), F.col("x").alias("ax")).join(b.select(F.col("i").alias("k"), "j", F.col("x").alias("bx")), "k").groupBy("i", "j").agg(F.sum(F.col("ax") * F.col("bx")).alias("x"))


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("i", "j").agg(F.sum("x").alias("x"))


def column_norms(cells: DataFrame) -> DataFrame:
    return cells.groupBy("j").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))


def unit_columns(cells: DataFrame) -> DataFrame:
    """Columns over their norms; a zero column becomes 1 in row 0."""
    norms = column_norms(cells)
    x = F.when(F.col("norm") == 0, F.when(F.col("i") == 0, 1.0).otherwise(0.0)).otherwise(F.col("x") / F.col("norm"))
    return cells.join(norms, "j").select("i", "j", x.alias("x"))


def written(rows: DataFrame, where: str, column: int, value: float, features: str = "features") -> DataFrame:
    """The matrix with one value written into a column of the rows that meet a condition."""
    changed = F.transform(features, lambda x, j: F.when(j == column, F.lit(float(value))).otherwise(x))
    return rows.withColumn(features, F.when(F.expr(where), changed).otherwise(F.col(features)))


def gram(rows: DataFrame, features: str = "features") -> DataFrame:
    """i, row: rows of the Gram matrix. Each task adds its rows up with one product a batch. Rows with nulls take no part."""
    rows, _ = uniform(rows, features)


    def partial(batches):
        from pyspark import TaskContext

        total = None
        for batch in batches:
            if batch.num_rows:
                block = batch_matrix(batch.column(0))
                total = block.T @ block + (0 if total is None else total)
        if total is not None:
            lane = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array([lane] * len(total), pa.int64()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "lane", "value"])

    rows = rows.select(features)
    parts = rows.mapInArrow(partial, "i int, lane bigint, value array<double>")
    return sum_arrays(parts, ["i"], lanes_of(rows)).withColumnRenamed("value", "row")


def _gram_matrix(rows: DataFrame, features: str) -> np.ndarray:
    width = uniform(rows, features)[1]
    if not width:
        raise ValueError("no rows")
    if width > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} columns; use the coordinate operators")
    out = np.zeros((width, width))
    for r in gram(rows, features).collect():
        out[r["i"]] = r["row"]
    return out


def svd(rows: DataFrame, row_id: str = "row_id", features: str = "features", sort: bool = False) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(u, s, v) with a = u diag(s) v'. u is a table (row_id, features); a zero singular value's column is left zero.

    By the Gram matrix: singular values under about 1e-8 of the largest are lost in its rounding and count as zero.
    """
    g = _gram_matrix(rows, features)
    rows = checked(rows, len(g), features)
    v = np.linalg.eigh(g)[1][:, ::-1]
    s = np.sqrt(np.maximum(np.einsum("ij,ij->j", v, g @ v), 0))
    if sort:
        order = np.argsort(-s)
        v, s = v[:, order], s[order]
    inverse = np.divide(v, s, out=np.zeros_like(v), where=s > 1e-8 * s.max(initial=0))

    def project(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch_matrix(batch.column(1)) @ inverse
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["row_id", "features"])

    u = rows.select(F.col(row_id).cast("bigint").alias("row_id"), F.col(features).cast("array<double>").alias("features")).mapInArrow(project, "row_id bigint, features array<double>")
    return u, s, v


def rounds_of(panels: int) -> list[list[tuple[int, int]]]:
    """Rounds of disjoint pairs in which every two panels meet once: one stays, the others move round."""
    ring = [*range(panels), *([None] if panels % 2 else [])]
    out = []
    for _ in range(len(ring) - 1):
        half = len(ring) // 2
        pairs = zip(ring[:half], reversed(ring[half:]), strict=True)
        out.append([(min(p), max(p)) for p in pairs if None not in p])
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def pair_rotation(gram: np.ndarray, scale: float, eps: float) -> np.ndarray | None:
    """The eigenvectors of two panels' common Gram matrix, largest first; None if their columns are orthogonal to within eps.

    scale: the squared norm of the whole matrix; columns under TINY of it are zero but for rounding.
    """
    size = np.diag(gram)
    large = size > TINY**2 * scale
    cosine = np.abs(gram[np.ix_(large, large)]) / np.sqrt(np.outer(size[large], size[large]))
    np.fill_diagonal(cosine, 0)
    if cosine.max(initial=0) <= eps:
        return None
    return np.ascontiguousarray(np.linalg.eigh(gram)[1][:, ::-1])


def _wide(batch: pa.RecordBatch) -> np.ndarray:
    return batch_matrix(batch.column(2))


def _turned(x: np.ndarray, held: list) -> np.ndarray:
    """Rows with rounds of rotations [(columns, matrix)] applied."""
    x = x.copy() if held else x
    for moves in held:
        for at, q in moves:
            x[:, at] = x[:, at] @ q
    return x


def _rotated(table: DataFrame, held: list) -> DataFrame:
    """A table (kind, row_id, features) with rounds of rotations applied to every row."""

    def turn(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(_turned(_wide(batch), held)), pa.list_(pa.float64()))], names=["kind", "row_id", "features"])

    return table.mapInArrow(turn, "kind int, row_id bigint, features array<double>") if held else table


def _pair_grams(table: DataFrame, columns: list[np.ndarray], held: list) -> DataFrame:
    """pair, gram (flat): the Gram matrices of some columns each, over rows of kind 0 after the held rotations; added up in two steps,
    so that no group grows with the tasks. The same Python worker turns a task's rows and multiplies them.
    """

    def partial(batches):
        from pyspark import TaskContext

        total = [np.zeros((len(c), len(c))) for c in columns]
        for batch in batches:
            own = batch.filter(pa.compute.equal(batch.column(0), 0))
            if own.num_rows:
                x = _turned(_wide(own), held)
                for t, c in zip(total, columns, strict=True):
                    t += x[:, c].T @ x[:, c]
        n = TaskContext.get().partitionId()
        for i, t in enumerate(total):
            if t.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([n % lanes], pa.int32()), pa.array([t.ravel()], pa.list_(pa.float64()))], names=["pair", "lane", "gram"])

    def add(group: pa.Table) -> pa.Table:
        whole = np.asarray(group["gram"].combine_chunks().flatten()).reshape(group.num_rows, -1).sum(axis=0)
        return pa.table({"pair": group["pair"][:1], "lane": pa.array([0], pa.int32()), "gram": pa.array([whole], pa.list_(pa.float64()))})

    lanes = math.ceil(math.sqrt(max(1, table.rdd.getNumPartitions())))
    schema = "pair int, lane int, gram array<double>"
    parts = table.mapInArrow(partial, schema)
    if lanes > 4:
        parts = parts.groupBy("pair", "lane").applyInArrow(add, schema)
    return parts.groupBy("pair").applyInArrow(add, schema).select("pair", "gram")


def panel_svd(rows: DataFrame, block: int = 128, row_id: str = "row_id", features: str = "features", sort: bool = False, eps: float = 1e-12, sweeps: int = 30) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """(u, s, v) with a = u diag(s) v', u and v as tables (row_id, features); a zero singular value's column of u is zero.

    One-sided block Jacobi: columns are cut into panels of ``block``; in each round of a sweep every panel
    meets one other, and the eigenvectors of the pair's Gram matrix turn both, until a sweep finds all
    columns orthogonal. Rows never move: tasks turn their own rows and those of v, and send one Gram matrix
    a pair, 2 * block columns wide. A round's rotations, 16 * width * block bytes, pass through the driver
    and must stay under MOST_BYTES. The table is written anew every HELD_ROUNDS rounds.
    """
    rows, width = uniform(rows, features)
    if not width:
        raise ValueError("no rows")
    block = max(1, min(block, -(-width // 2)))
    if 16 * width * block > MOST_BYTES:
        raise ValueError("a round's rotations are too large; use a smaller block")
    panels = [np.arange(a, min(a + block, width)) for a in range(0, width, block)]
    unit = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.when(j == F.col("id"), 1.0).otherwise(0.0))
    identity = rows.sparkSession.range(width).select(F.lit(1).alias("kind"), F.col("id").alias("row_id"), unit.alias("features"))
    table = rows.select(F.lit(0).alias("kind"), F.col(row_id).cast("bigint").alias("row_id"), F.col(features).cast("array<double>").alias("features"))
    table, held = kept(table.unionByName(identity)), []
    scale = table.where("kind = 0").agg(F.sum(F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x)).alias("n")).first()["n"] or 0.0
    for _ in range(sweeps):
        moved = False
        for pairs in rounds_of(len(panels)):
            columns = [np.concatenate([panels[a], panels[b]]) for a, b in pairs]
            moves = []
            for r in _pair_grams(table, columns, held).collect():
                at = columns[r["pair"]]
                q = pair_rotation(np.array(r["gram"]).reshape(len(at), len(at)), scale, eps)
                if q is not None:
                    moves.append((at, q))
            if moves:
                moved, held = True, [*held, moves]
            if len(held) == HELD_ROUNDS:
                table, held = kept(_rotated(table, held)), []
        if not moved:
            break
    table = kept(_rotated(table, held))
    squares = table.where("kind = 0").select(F.posexplode("features").alias("j", "x")).groupBy("j").agg(F.sum(F.col("x") * F.col("x")).alias("n"))
    s = np.zeros(width)
    for r in squares.collect():
        s[r["j"]] = math.sqrt(r["n"])
    order = np.argsort(-s, kind="stable") if sort else np.arange(width)
    s = s[order]
    inverse = np.divide(1.0, s, out=np.zeros_like(s), where=s > TINY * math.sqrt(scale))

    def out(kind: int, by: np.ndarray) -> DataFrame:
        def pick(batches):
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(_wide(batch)[:, order] * by), pa.list_(pa.float64()))], names=["row_id", "features"])

        return table.where(F.col("kind") == kind).mapInArrow(pick, "row_id bigint, features array<double>")

    return out(0, inverse), s, out(1, np.ones(width))
