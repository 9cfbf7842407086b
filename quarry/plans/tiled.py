"""Block matrices and dense reductions over embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import panels
from quarry.operators.histogram import dense_partials
from quarry.operators.reduction import sum_arrays
from quarry.operators.tiles import TiledMatrix
from quarry.plans.registry import points, query, rounded

BLOCK = 48  # does not divide 64 columns, so that edges are ragged
_X = "x as (select vec_id i, unnest(range(64)) j, unnest(embedding::double[]) x from embeddings)"


def _matrix(spark, d: str) -> TiledMatrix:
    return TiledMatrix.of_rows(points(spark, d), block=BLOCK)


def _cells(matrix: TiledMatrix) -> DataFrame:
    return matrix.cells().select("i", F.col("j").cast("bigint").alias("j"), rounded("x").alias("x"))


@query(f"with {_X} select a.j::bigint i, b.j::bigint j, round(sum(a.x * b.x), 6) x from x a join x b using (i) group by a.j, b.j")
def tile_matmul(spark, d):
    """The transpose times the matrix, tile by tile."""
    x = _matrix(spark, d)
    return _cells(x.transpose().matmul(x))


@query(f"with {_X}, g as (select a.j i, b.j j, sum(a.x * b.x) x from x a join x b using (i) group by a.j, b.j) select x.i, g.j::bigint j, round(sum(x.x * g.x), 6) x from x join g on x.j = g.i group by x.i, g.j")
def tile_matmul_chain(spark, d):
    """The matrix times its Gram matrix: as many rows of tiles as the table has."""
    x = _matrix(spark, d)
    return _cells(x.matmul(x.transpose().matmul(x)))


@query(f"with {_X} select i, j::bigint j, round(x + 0.5::double * x, 6) x from x")
def tile_add(spark, d):
    x = _matrix(spark, d)
    return _cells(x.add(x.scale(0.5)))


@query(f"with {_X} select j::bigint i, i j, round(x, 6) x from x")
def tile_transpose(spark, d):
    return _cells(_matrix(spark, d).transpose())


@query(f"with {_X}, n as (select max(i) + 1 n from x) select i - n // 3 i, (j - 10)::bigint j, round(x, 6) x from x, n where i >= n // 3 and j >= 10 and j < 61")
def tile_slice(spark, d):
    """From a third of the rows on, columns 10 to 60: pieces of tiles make new tiles."""
    x = _matrix(spark, d)
    return _cells(x.slice((x.rows // 3, x.rows), (10, 61)))


@query(
    "with b as (select case when x = 0.6::double then 3 else cast(floor((x + 0.6::double) / 0.3::double) as bigint) end b, vec_id, k from (select vec_id, unnest(range(5)) k, unnest((embedding::double[])[1:5]) x from embeddings) where x between -0.6::double and 0.6::double), "
    "c as (select sum(b * (4 ** k)::bigint)::bigint cell from b group by vec_id having count(*) = 5), n as (select cell, count(*) n from c group by cell) "
    "select r.cell, coalesce(n.n, 0)::double cnt from (select unnest(range(1024)) cell) r left join n using (cell)"
)
def hist_dense_reduced(spark, d):
    """All 4^5 cells as one dense array a block of rows, added up by arity."""
    p = points(spark, d).repartition(64, "row_id")
    parts = dense_partials(p, [(-0.6, 0.6)] * 5, 4)
    total = sum_arrays(parts, [], 64, arity=4)
    return total.select(F.posexplode("value").alias("cell", "cnt")).select(F.col("cell").cast("bigint").alias("cell"), "cnt")


@query(
    f"with {_X}, g as (select a.j i, b.j j, sum(a.x * b.x) x from x a join x b using (i) group by a.j, b.j), g2 as (select a.i, b.j, sum(a.x * b.x) x from g a join g b on a.j = b.i group by a.i, b.j) "
    "select round((select sum(x) from g where i = j), 6) squares, round((select sum(x * x) from g), 5) fourths, round((select sum(g2.x * g.x) from g2 join g using (i, j)), 4) sixths"
)
def svd_panels(spark, d):
    """The moments of the singular values by column panels, which the powers of the Gram matrix have as traces."""
    _, s, _ = panels.svd(TiledMatrix.of_rows(points(spark, d), block=32))
    return s.agg(*[F.round(F.sum(F.pow("s", F.lit(n))), digits).alias(name) for n, digits, name in ((2, 6, "squares"), (4, 5, "fourths"), (6, 4, "sixths"))])
