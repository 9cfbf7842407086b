"""Exact nearest neighbours by the spatial index, on columns of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.spatial import SpatialIndex
from quarry.plans.registry import query, rounded, table

#: The points of a table: id and coordinates, the same in Spark and SQL.
_LINES = ("l_orderkey * 8 + l_linenumber", ["l_quantity", "l_extendedprice / 1000", "l_discount * 100"])
_PARTS = ("p_partkey", ["cast(p_size as double)", "p_retailprice / 1000", "0.5"])
_CUSTOMERS = ("c_custkey", ["cast(c_nationkey as double)", "c_acctbal / 1000", "0.5"])


def _points(spark, d: str, name: str, of) -> DataFrame:
    i, coordinates = of
    return table(spark, d, name).select(F.expr(i).cast("bigint").alias("row_id"), F.array(*[F.expr(c).cast("double") for c in coordinates]).alias("features"))


def _sql(name: str, of, where: str = "true") -> str:
    i, coordinates = of
    return f"select {i} i, {', '.join(f'({c})::double x{n}' for n, c in enumerate(coordinates))} from {name} where {where}"


def _near(fit: str, asked: str, k: int) -> str:
    """SQL of the k nearest of fit for every row of asked: the least k structs of distance and id."""
    dist = "sqrt((q.x0 - f.x0) * (q.x0 - f.x0) + (q.x1 - f.x1) * (q.x1 - f.x1) + (q.x2 - f.x2) * (q.x2 - f.x2))"
    return (
        f"select i query_id, generate_subscripts(b, 1) rnk, unnest(b).i neighbor_id, round(unnest(b).d, 6) dist from "
        f"(select q.i, min({{'d': {dist}, 'i': f.i}}, {k}) b from ({asked}) q, ({fit}) f group by q.i, q.x0, q.x1, q.x2)"
    )


def _ranked(found: DataFrame) -> DataFrame:
    return found.select("query_id", F.col("rank").cast("bigint").alias("rnk"), "neighbor_id", rounded("dist").alias("dist"))


@query(_near(_sql("lineitem", _LINES), _sql("lineitem", _LINES, "(l_orderkey * 8 + l_linenumber) % 20 = 0"), 5))
def knn_index_lineitem(spark, d):
    """Every twentieth row of lineitem among all its rows."""
    rows = _points(spark, d, "lineitem", _LINES)
    return _ranked(SpatialIndex(5).fit(rows).kneighbors(rows.where("row_id % 20 = 0")))


_TWICE = " union all ".join(
    f"select '{name}' asked, query_id, rnk, neighbor_id, dist from ({_near(_sql('lineitem', _LINES), _sql(name, of, f'{of[0]} % 20 = 0'), 3)})" for name, of in (("part", _PARTS), ("customer", _CUSTOMERS))
)


@query(_TWICE)
def knn_index_asked_twice(spark, d):
    """One index of lineitem, asked for the neighbours of parts and then of customers."""
    index = SpatialIndex(3).fit(_points(spark, d, "lineitem", _LINES))
    out = [_ranked(index.kneighbors(_points(spark, d, name, of).where("row_id % 20 = 0"))).withColumn("asked", F.lit(name)) for name, of in (("part", _PARTS), ("customer", _CUSTOMERS))]
    return out[0].unionByName(out[1])


@query()
def knn_index_embeddings(spark, d):
    """Every twentieth vector of embeddings among all: many dimensions, of which the boxes can rule out little."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("features"))
    return _ranked(SpatialIndex(5).fit(rows).kneighbors(rows.where("row_id % 20 = 0")))
