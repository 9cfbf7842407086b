"""Bootstrap intervals and binned densities of events, against the same hashes and bins in SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quarry.functions import random
from quarry.operators.resample import POISSON, binned_density, bootstrap_means
from quarry.plans.registry import query, rounded, table

_B = 60
_SALTS = "[" + ", ".join(f"{{'a': {a}, 'b': {b}}}" for a, b in random.salts(_B, 42)) + "]"
_CDF = "[" + ", ".join(f"{p!r}::double" for p in POISSON) + "]"


def _at(q: float) -> str:
    return f"quantile_cont(m, {q!r}) filter (where m is not null)"


@query(
    f"with e as (select event_type g, event_id i, value v from events where value is not null and event_type is not null), "
    f"d as (select g, v, b, {random.uniform_sql_of('i', 's.a', 's.b')} u from (select g, i, v, unnest(range({_B})) b, unnest({_SALTS}) s from e)), "
    f"w as (select g, v, b, len(list_filter({_CDF}, lambda p: p <= u)) w from d), r as (select g, b, sum(w * v) / nullif(sum(w), 0) m from w group by g, b), "
    f"t as (select g, count(*) n, avg(v) mean from e group by g) "
    f"select t.g event_type, any_value(t.n) n, round(any_value(t.mean), 6) mean, round({_at((1 - 0.95) / 2)}, 6) lo, round({_at((1 + 0.95) / 2)}, 6) hi from t join r using (g) group by t.g"
)
def bootstrap_interval(spark, d):
    """The mean of each event type with its 95 % interval, over 60 Poisson replicates."""
    made = bootstrap_means(table(spark, d, "events"), ["event_type"], "value", "event_id", _B)
    return made.select("event_type", "n", *[rounded(c).alias(c) for c in ("mean", "lo", "hi")])


@query(
    "with e as (select event_type g, value v from events where value is not null and event_type is not null), "
    "t as (select g, count(*) n, stddev_samp(v) * 0.1::double h, min(v) lo, max(v) hi from e group by g having count(*) > 1 and stddev_samp(v) > 0), "
    "s as (select *, lo - 3.0::double * h start, (hi + 3.0::double * h - (lo - 3.0::double * h)) / 511.0::double step from t), "
    "p as (select g, (v - start) / step a, least(floor((v - start) / step), 510)::int b from e join s using (g)), "
    "w as (select g, bin, sum(w) w from (select g, b bin, b + 1 - a w from p union all select g, b + 1, a - b from p) group by g, bin), "
    f"x as (select g, a, start + a * (step * {511 / 63!r}::double) x, start, step, h, n from s, (select unnest(range(64)) a)) "
    f"select g event_type, a at_, round(any_value(x), 6) x, round(sum(w * exp(-0.5::double * ((x - (start + bin * step)) / h) ** 2)) / any_value(n * h * {math.sqrt(2 * math.pi)!r}::double), 9) density from x join w using (g) group by g, a"
)
def density_binned(spark, d):
    """The density of each event type's values on 64 points, from 512 bins."""
    made = binned_density(table(spark, d, "events"), ["event_type"], "value")
    return made.select("event_type", F.col("at").cast("bigint").alias("at_"), rounded("x").alias("x"), rounded("density", 9).alias("density"))
