"""The streaming histogram: restarts from a checkpoint, batches that run twice, and late rows."""

import shutil
from datetime import datetime

from pyspark.sql import functions as F

from quarry.streaming.histogram import counts_so_far, run_available, windowed_histogram

DDL = "ts timestamp, v double"


def _rows(*pairs):
    return [(datetime(2026, 1, 1, h, m), float(v)) for h, m, v in pairs]


def _hist(spark, folder, late="10 days"):
    return windowed_histogram(spark.readStream.schema(DDL).parquet(folder), [F.col("v")], 4, 0.0, 1.0, "ts", "1 hour", late)


def _got(hist, out):
    return {(r["start"].hour, r["b0"]): r["cnt"] for r in counts_so_far(hist, out).collect()}


def test_restart_counts_every_row_once(spark, tmp_path):
    arrived, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    spark.createDataFrame(_rows((1, 5, 0.1), (1, 6, 0.1), (2, 0, 1.0), (2, 1, 1.5)), DDL).write.mode("append").parquet(arrived)
    hist = _hist(spark, arrived)
    assert _got(hist, out) == {}
    run_available(hist, out)
    assert _got(hist, out) == {(1, 0): 2, (2, 3): 1}
    run_available(_hist(spark, arrived), out)  # nothing new
    assert _got(hist, out) == {(1, 0): 2, (2, 3): 1}
    spark.createDataFrame(_rows((1, 7, 0.2), (3, 0, 0.5)), DDL).write.mode("append").parquet(arrived)
    run_available(_hist(spark, arrived), out)
    assert _got(hist, out) == {(1, 0): 3, (2, 3): 1, (3, 2): 1}


def test_a_batch_that_runs_again_after_a_failure_counts_once(spark, tmp_path):
    arrived, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    spark.createDataFrame(_rows((1, 5, 0.1)), DDL).write.mode("append").parquet(arrived)
    run_available(_hist(spark, arrived), out)
    spark.createDataFrame(_rows((1, 6, 0.1), (4, 6, 0.9)), DDL).write.mode("append").parquet(arrived)
    hist = _hist(spark, arrived)
    run_available(hist, out)
    want = {(1, 0): 2, (4, 3): 1}
    assert _got(hist, out) == want
    # As if the driver had been lost after the last batch was written and before it was committed.
    last = sorted(int(p.name) for p in (tmp_path / "out/checkpoint/commits").iterdir() if p.name.isdigit())[-1]
    for name in (f"{last}", f".{last}.crc"):
        (tmp_path / f"out/checkpoint/commits/{name}").unlink(missing_ok=True)
    run_available(_hist(spark, arrived), out)
    assert _got(hist, out) == want


def test_rows_later_than_the_watermark_are_dropped(spark, tmp_path):
    arrived, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for rows in (_rows((9, 0, 0.1)), _rows((8, 50, 0.1), (9, 30, 0.6)), _rows((1, 0, 0.1), (9, 45, 0.6))):
        spark.createDataFrame(rows, DDL).write.mode("append").parquet(arrived)
        run_available(_hist(spark, arrived, "1 hour"), out)
    got = _got(_hist(spark, arrived, "1 hour"), out)
    assert got == {(9, 0): 1, (8, 0): 1, (9, 2): 2}
    shutil.rmtree(tmp_path / "in")
