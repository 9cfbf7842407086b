"""The histogram over a stream: a running count a cell, or one a window with late rows dropped by a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.histogram import cell


def windowed_histogram(stream: DataFrame, columns: Sequence[Column], bins: int, lo: float, hi: float, time: str, window: str, late: str) -> DataFrame:
    names = [f"b{i}" for i in range(len(columns))]
    cells = stream.withWatermark(time, late).select(F.col(time), *[cell(c, lo, hi, bins).alias(n) for n, c in zip(names, columns, strict=True)]).dropna(subset=names)
    return cells.groupBy(F.window(time, window).alias("w"), *names).agg(F.count("*").alias("cnt"))


def run_available(hist: DataFrame, folder: str) -> None:
    """Take in what a stream's source has now and stop. Each batch's changed counts are a folder of its own under ``folder``.

    The checkpoint beside them knows which files were read and the counts so far, so that the next call, after a stop or a
    failure, goes on from there; a batch that is run again overwrites its own folder, so that nothing counts twice.
    """

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batches/{n:09d}")

    query = hist.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()


def counts_so_far(hist: DataFrame, folder: str) -> DataFrame:
    """start, cells, cnt: of each window and cell the count of the last batch that changed it."""
    spark = hist.sparkSession
    names = [c for c in hist.columns if c not in ("w", "cnt")]
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batches")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], hist.schema).select(F.col("w.start").alias("start"), *names, "cnt")
    batches = spark.read.schema(hist.schema).parquet(f"{folder}/batches/*").withColumn("_batch", F.regexp_extract(F.input_file_name(), r"/batches/(\d+)/", 1))
    return batches.groupBy(F.col("w.start").alias("start"), *names).agg(F.max_by("cnt", "_batch").alias("cnt"))
