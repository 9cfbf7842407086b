"""Queries of the append log, of parameter grids from the run log's own values, and of sums by chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.tables import new_path
from quarry.operators.runlog import numbered
from quarry.plans.catalog import _runs
from quarry.plans.registry import query, rounded, table
from quarry.plans.sql import RUNS
from quarry.sources.append_log import AppendLog


@query(
    "with e as (select user_id k, event_id s, value v, event_type t from events where user_id is not null), a as (select k, list(v order by s, v) items from e where t <> 'purchase' group by k), "
    "s as (select k, max_by(v, (s, -v)) v from e where t = 'purchase' group by k) "
    "select coalesce(a.k, s.k) k, round(s.v, 6) last_purchase, coalesce(len(items), 0)::bigint n, round(items[1], 6) first_item, round(items[-1], 6) last_item, round(list_sum(list_transform(range(1, len(items) + 1), lambda i: i * items[i])), 4) in_order from a full join s on a.k = s.k"
)
def runlog_append_fold(spark, d):
    """Events appended to their user's list by two writers, and purchases set, with a compaction between: each list in order."""
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), "value", "event_type")
    log = AppendLog(spark, new_path(spark, "append_log"))
    log.append(e.where("event_type <> 'purchase' and seq % 2 = 1"), "values")
    log.set(e.where("event_type = 'purchase' and seq % 3 <> 0"), "purchase")
    log.compact()
    log.append(e.where("event_type <> 'purchase' and seq % 2 = 0"), "values")
    log.set(e.where("event_type = 'purchase' and seq % 3 = 0"), "purchase")
    rows = log.read()
    lists = rows.where("field = 'values'").select(F.col("key").alias("k"), "items")
    last = rows.where("field = 'purchase'").select(F.col("key").alias("k"), F.col("value").alias("last"))
    both = lists.join(last, "k", "full")
    weighed = F.aggregate(F.transform("items", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return both.select("k", rounded("last").alias("last_purchase"), F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n"), rounded(F.get("items", F.lit(0))).alias("first_item"), rounded(F.element_at("items", -1)).alias("last_item"), F.round(weighed, 4).alias("in_order"))


_GRID = "(select distinct nodes from runs), (select distinct points_per_fragment from runs), (select distinct use_split from runs)"


@query(RUNS + f", g as (select * from {_GRID}), n as (select nodes, points_per_fragment, use_split, count(*) n from runs group by all) select g.nodes, g.points_per_fragment, g.use_split::bigint use_split, power(2, x)::bigint workers, coalesce(n, 0) n from g left join n on n.nodes = g.nodes and n.points_per_fragment = g.points_per_fragment and n.use_split is not distinct from g.use_split, (select unnest(range(5)) x)")
def runlog_grid_from_log(spark, d):
    """All combinations of the values that the log's parameters take and 2^0 .. 2^4 workers, with the runs of each; as large as its own values."""
    runs = _runs(spark, d)
    grid = runs.select("nodes").distinct().crossJoin(runs.select("points_per_fragment").distinct()).crossJoin(runs.select("use_split").distinct())
    n = runs.groupBy("nodes", "points_per_fragment", "use_split").agg(F.count("*").alias("n")).toDF("a", "b", "c", "n")
    met = grid.join(n, (F.col("nodes") == F.col("a")) & (F.col("points_per_fragment") == F.col("b")) & F.col("use_split").eqNullSafe(F.col("c")), "left")
    sweep = F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda x: F.pow(F.lit(2.0), x).cast("bigint")))
    return met.select("nodes", "points_per_fragment", "use_split", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), sweep.alias("workers"))


@query(
    "with l as (select l_quantity q, row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 i from lineitem), c as (select i // 48 c, sum(q) s, count(*) n from l group by 1) "
    "select count(*) chunks, max(n) most, sum(n)::bigint n, round(sum(s), 4) total from c"
)
def reduction_by_chunks(spark, d):
    """The sum of a column by chunks of 48 rows, and of the chunks: lines numbered by ranges of their order."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    rows = numbered(table(spark, d, "lineitem").select("l_quantity", *order), [F.col(c) for c in order], "i")
    chunks = rows.groupBy(F.floor((F.col("i") - 1) / 48).alias("c")).agg(F.sum("l_quantity").alias("s"), F.count("*").alias("n"))
    return chunks.agg(F.count("*").alias("chunks"), F.max("n").alias("most"), F.sum("n").alias("n"), F.round(F.sum("s"), 4).alias("total"))
