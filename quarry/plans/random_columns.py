"""Counter-based random columns over the given tables, against the same formulas in SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quarry.functions import random
from quarry.plans.registry import points, query, rounded, table
from quarry.sources import generate

_SALTS = "[" + ", ".join(f"{{'a': {a}, 'b': {b}, 'c': {c}, 'd': {d}}}" for (a, b), (c, d) in zip(random.salts(64, 7, 0), random.salts(64, 7, 1), strict=True)) + "]"
_U1, _U2 = random.uniform_sql_of("i", "s.a", "s.b"), random.uniform_sql_of("i", "s.c", "s.d")


@query(f"with x as (select vec_id i, unnest(range(64)) j, unnest(embedding::double[]) x, unnest({_SALTS}) s from embeddings) select i row_id, j::bigint j, round(x + 0.01::double * sqrt(-2 * ln(1 - {_U1})) * cos({2 * math.pi!r}::double * {_U2}), 6) x from x")
def noisy_embeddings(spark, d):
    """Embeddings with normal noise by vec_id and component."""
    noisy = generate.with_noise(points(spark, d), 0.01, seed=7)
    return noisy.select("row_id", F.posexplode("features").alias("j", "x")).select("row_id", F.col("j").cast("bigint").alias("j"), rounded("x").alias("x"))


@query(f"select l_returnflag, count(*) n, round(avg(u), 6) mean, count(*) filter (where u < 0.1) low from (select l_returnflag, {random.uniform_sql('l_orderkey * 8 + l_linenumber', 3, 11)} u from lineitem) group by l_returnflag")
def random_share_lineitem(spark, d):
    """A uniform column by order and line, and how many rows a share of a tenth draws."""
    u = random.uniform(F.col("l_orderkey") * 8 + F.col("l_linenumber"), 3, 11)
    rows = table(spark, d, "lineitem").select("l_returnflag", u.alias("u"))
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), rounded(F.avg("u")).alias("mean"), F.count_if(F.col("u") < 0.1).alias("low"))
