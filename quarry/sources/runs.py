"""Run logs: read, append and take the last record of each run; benchmark timings as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BENCHMARK = "multiplier int, fit double, kneighbors double"
RUN_LOG = "id bigint, start_ts timestamp_ntz, finish_ts timestamp_ntz, initialization_time double, nodes bigint, tracing bigint, dataclay bigint, use_split bigint, copy_fit_struct bigint, points_per_fragment bigint, number_of_fragments bigint, iteration_time array<double>, version bigint"


def read_benchmark(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    return spark.read.schema(BENCHMARK).option("header", header).csv(path)


def append_benchmark(rows: DataFrame, path: str) -> None:
    """Append timing rows without a header."""
    rows.select("multiplier", "fit", "kneighbors").write.mode("append").csv(path)


def append_runs(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """A run log by its fixed schema; columns that a file lacks are null."""
    return spark.read.schema(RUN_LOG).parquet(path)


def last_write(log: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """The record of the highest version of each key, all columns."""
    others = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*others), F.col(version)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in others])


def decode_seconds(column: str):
    """A JSON list column as array<double>; null where it is malformed."""
    return F.from_json(F.col(column), "array<double>")
