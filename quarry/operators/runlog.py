"""Relational work on a run log: modes, suffixes, winsorised means, speed-ups, cost projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.tables import kept

# The names of the three modes that the logs and their readers use, and the marks below.
MEMORY, PLAIN, SPLIT = "dataClay", "COMPSs", "dataClay+split"
SHORT_MEMORY, SHORT_SPLIT, REDUCTION = "dC", "dC+split", "+reduction"


def numbered(rows: DataFrame, order: Sequence[Column], name: str, within: Sequence[str] = ()) -> DataFrame:
    """Row numbers from 1 in an order, among equal columns ``within`` (which must lead the order).

    Rows are dealt to ranges of the order and numbered there, plus the number of rows in the ranges
    before, of which there is one row a range. The ranges are kept, as they must not be drawn anew.
    """
    session = rows.sparkSession
    ranged = rows.repartitionByRange(int(session.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_part", F.spark_partition_id())
    ranged = kept(ranged)
    counts = ranged.groupBy("_part", *within).count()
    keys = [F.col(c).alias(f"_{c}") for c in within]
    before = counts.select(F.col("_part").alias("_range"), *keys, (F.sum("count").over(Window.partitionBy(*within).orderBy("_part")) - F.col("count")).alias("_before"))
    same = F.col("_part") == F.col("_range")
    for c in within:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    inside = F.row_number().over(Window.partitionBy("_part", *within).orderBy(*order))
    # Sent to every task only if Spark finds it small enough.
    return ranged.withColumn(name, inside).join(before, same).withColumn(name, F.col(name) + F.col("_before")).select(*rows.columns, name)


def with_mode(runs: DataFrame) -> DataFrame:
    """Untraced runs (no tracing column: all) with a mode; null where no rule matches."""
    if "tracing" in runs.columns:
        runs = runs.where("tracing = 0")
    mode = F.when(F.col("dataclay") == 0, PLAIN).when((F.col("dataclay") == 1) & (F.col("use_split") == 0), MEMORY).when((F.col("dataclay") == 1) & (F.col("use_split") == 1), SPLIT)
    return runs.withColumn("mode", mode)


def default_copy(runs: DataFrame) -> DataFrame:
    """copy_fit_struct is 1 where objects persist and it isn't 0, null included."""
    cfs = F.col("copy_fit_struct")
    return runs.withColumn("copy_fit_struct", F.when((F.col("dataclay") == 1) & ~cfs.eqNullSafe(F.lit(0)), F.lit(1)).otherwise(cfs))


def with_suffix(runs: DataFrame) -> DataFrame:
    """Marks in the mode's name, for the columns that the log has."""
    mode = F.col("mode")
    if "copy_fit_struct" in runs.columns:
        mode = F.when((F.col("dataclay") == 1) & (F.col("copy_fit_struct") == 0), F.concat(mode, F.lit("[no copy]"))).otherwise(mode)
    if "use_active" in runs.columns:
        mark = F.when(F.col("use_active") == 1, F.lit("[active]")).when(F.col("use_active") == 0, F.lit("[non-active]"))
        mode = F.when((F.col("dataclay") == 1) & mark.isNotNull(), F.concat(mode, mark)).otherwise(mode)
    return runs.withColumn("mode", mode)


def without(runs: DataFrame, ids: Sequence[int], key: str = "id") -> DataFrame:
    """Rows whose key is not listed; null keys stay."""
    listed = runs.sparkSession.createDataFrame([(i,) for i in ids], f"{key} bigint")
    return runs.join(F.broadcast(listed), key, "left_anti")


def keep_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select([c for c in df.columns if c in set(names)])


def exploded(runs: DataFrame, column: str) -> DataFrame:
    """One row an element; an empty or null list keeps one row with null."""
    return runs.withColumn(column, F.explode_outer(column))


def ranked_values(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """keys, value, rn (from 1) and n of every value that isn't null, by ranges of keys and value: no group is one task's."""
    known = df.where(F.col(value).isNotNull()).select(*keys, value)
    ranked = numbered(known, [*[F.asc_nulls_last(k) for k in keys], F.col(value)], "rn", keys)
    return _beside(ranked, known.groupBy(*keys).agg(F.count("*").alias("n")), keys)


def _beside(df: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df with the columns of a table of one row a group; null keys meet each other."""
    groups = groups.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in groups.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(groups, same, "left").drop(*[f"_{k}" for k in keys])


def winsorized(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Within each group of five values or more, without a null key, the top tenth is clamped to the largest value below it."""
    grouped = F.lit(True)
    for k in keys:
        grouped = grouped & F.col(k).isNotNull()
    values = ranked_values(df.where(grouped), value, keys)
    caps = values.where((F.col("n") >= 5) & (F.col("rn") == F.col("n") - F.floor(F.col("n") * 0.1))).select(*keys, F.col(value).alias("_cap"))
    clamped = F.when(F.col("_cap").isNotNull() & F.col(value).isNotNull(), F.least(value, "_cap")).otherwise(F.col(value))
    return _beside(df, caps, keys).withColumn(value, clamped).drop("_cap")


def group_mean(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Means by group; rows with a null key belong to none."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.avg(value).alias(value))


def quartiles(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Quartiles by linear interpolation between the two values around each, the least and the largest value."""
    values = ranked_values(df, value, keys)
    at = {name: q * (F.col("n") - 1) for q, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))}
    some = F.col("rn").isin(1) | (F.col("rn") == F.col("n"))
    for x in at.values():
        some = some | (F.col("rn") - 1).between(F.floor(x), F.ceil(x))
    parts = []
    for name, x in at.items():
        share = F.when(F.col("rn") - 1 == F.floor(x), 1 - (x - F.floor(x))).when(F.col("rn") - 1 == F.ceil(x), x - F.floor(x)).otherwise(0.0)
        parts.append(F.sum(share * F.col(value)).alias(name))
    found = values.where(some).groupBy(*keys).agg(*parts, F.min(value).alias("low"), F.max(value).alias("high"))
    return _beside(df.select(*keys).distinct(), found, keys)


def list_summary(runs: DataFrame, column: str) -> DataFrame:
    """min_time, mean_time, std_time (of the whole list) and count of each run's list; all null where it is null or empty."""
    some, n = F.size(column) > 0, F.size(column)
    mean = F.aggregate(column, F.lit(0.0), lambda s, x: s + x) / n
    spread = F.sqrt(F.aggregate(F.transform(column, lambda x: (x - F.col("mean_time")) * (x - F.col("mean_time"))), F.lit(0.0), lambda s, x: s + x) / n)
    runs = runs.withColumn("mean_time", F.when(some, mean))
    return runs.withColumns({"min_time": F.when(some, F.array_min(column)), "std_time": F.when(some, spread), "count": F.when(some, n.cast("bigint"))})


def short_mode(reduction: Column) -> Column:
    """The short label of a run's mode, marked where it reduces."""
    mode = F.when(F.coalesce("dataclay", F.lit(0)) == 0, PLAIN).when(F.coalesce("use_split", F.lit(0)) != 0, SHORT_SPLIT).otherwise(SHORT_MEMORY)
    return F.concat(mode, F.when(F.coalesce(reduction, F.lit(0)) != 0, REDUCTION).otherwise(""))


def interval(df: DataFrame, value: str, keys: Sequence[str], z: float = 1.96) -> DataFrame:
    """mean, and low and high of its normal interval, by group; null where a group has one value."""
    half = z * F.stddev_samp(value) / F.sqrt(F.count(value))
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.avg(value).alias("mean"), (F.avg(value) - half).alias("low"), (F.avg(value) + half).alias("high"))


def density(df: DataFrame, value: str, keys: Sequence[str], grid: Sequence[float], bandwidth: float, relative: bool = False) -> DataFrame:
    """Gaussian kernel density at fixed grid points, pre-aggregated; relative: the bandwidth is a factor of each group's sample deviation."""
    at = F.explode(F.array(*[F.lit(float(x)) for x in grid]))
    rows = df.where(F.col(value).isNotNull())
    width = F.lit(float(bandwidth))
    if relative:
        rows = _beside(rows, rows.groupBy(*keys).agg(F.stddev_samp(value).alias("_sd")), keys)
        width = F.col("_sd") * bandwidth
    rows = rows.select(*keys, F.col(value).alias("_v"), width.alias("_w"), at.alias("x"))
    z = (F.col("x") - F.col("_v")) / F.col("_w")
    weight = F.exp(-z * z / 2) / (F.col("_w") * (2 * 3.141592653589793) ** 0.5)
    return rows.groupBy(*keys, "x").agg(F.avg(weight).alias("density"))


def granularity(fragments: Column, per: int = 48 * 8) -> Column:
    return F.floor(fragments / per)


def job_id(text: Column) -> Column:
    return F.regexp_extract(text, r"Submitted batch job (\d+)", 1)


def cost(means: DataFrame, plans: DataFrame, query_blocks: int = 24) -> DataFrame:
    """Projected times of plans (n, m): n blocks, m stacked to a structure; means (m, fit, kn)."""
    rows = plans.join(F.broadcast(means), "m")
    groups = F.floor(F.col("n") / F.col("m"))
    kn = F.col("kn") * groups
    total = F.col("fit") + kn
    return rows.select("n", "m", (F.col("fit") * groups).alias("agg_fit"), F.col("fit").alias("time_fit"), (kn * query_blocks).alias("agg_kn"), kn.alias("time_kn"), total.alias("total"), (F.col("fit") * 100 / total).alias("ratio"))
