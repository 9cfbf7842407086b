"""The streaming histogram over events that arrive in files, stopped and started again."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.tables import new_path
from quarry.plans.registry import query, table
from quarry.streaming.histogram import counts_so_far, run_available, windowed_histogram

FILES = 3


@query(
    "select date_trunc('day', ts)::timestamp as \"start\", case when value = 100 then 9 else floor(value / 10::double) end::bigint b0, count(*) cnt from events where value between 0 and 100 and ts is not null group by 1, 2"
)
def hist_stream_events(spark, d):
    """Counts of values by day and cell: a third of the events is taken in, then another and the rest after a restart each."""
    events = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    arrived, folder = new_path(spark, "arrived"), new_path(spark, "stream")
    for n in range(FILES):
        events.where(F.pmod("event_id", F.lit(FILES)) == n).write.mode("append").parquet(arrived)
        stream = spark.readStream.schema(events.schema).parquet(arrived)
        # Lateness beyond all of the table, as its rows do not arrive in order of time.
        hist = windowed_histogram(stream, [F.col("value")], 10, 0.0, 100.0, "ts", "1 day", "36500 days")
        run_available(hist, folder)
    found = counts_so_far(hist, folder)
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("b0").cast("bigint").alias("b0"), "cnt")
