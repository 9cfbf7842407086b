"""Shared storage for intermediate tables, and batch-wise maps over whole documents."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_ROWS = 100_000
MOST_BYTES = 8_000_000
SALTS = 16


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    Where it is unset, a session on one machine (tests) gets a folder of that machine; on a cluster it must be set.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='quarry-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/quarry/{spark.sparkContext.applicationId}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(*tables: DataFrame) -> None:
    """Delete the files of tables made by saved() that nothing needs any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/quarry/" in folder:
                _delete(df.sparkSession, folder)


def clear(spark: SparkSession) -> None:
    """Delete every table that saved() has written for this application; for use once results are stored."""
    _delete(spark, _own_folder(spark))


def packed(docs: DataFrame) -> Column:
    """A row's own columns as one struct, so that helper columns beside it can't clash with any of them; select("row.*") restores them."""
    return F.struct(*[F.col(_quoted(c)) for c in docs.columns]).alias("row")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def row_hash(docs: DataFrame) -> Column:
    """A hash of all of a row's columns; maps, which can't be hashed, as their JSON."""
    names = {f.name: F.col(_quoted(f.name)) for f in docs.schema.fields}
    return F.xxhash64(*[F.to_json(names[f.name]) if "map<" in f.dataType.simpleString() else names[f.name] for f in docs.schema.fields])


def document_table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, n: int):
    """crc32 of the id's decimal text, modulo n: the split into learned and held-out rows."""
    return F.crc32(F.col(column).cast("string")) % n


def attach(rows: DataFrame, small: DataFrame, key: str, spread: Column, how: str = "inner") -> DataFrame:
    """Rows with the columns of a saved table of one row a key; null keys meet each other. how: inner or left.

    The table is sent to every task if its size, which is looked up, stays under MOST_ROWS and
    MOST_BYTES. Beyond, it is joined by shuffle, each of its rows SALTS times and each of the others
    dealt to one of them by the hash ``spread``, so that a key with a large part of all rows is many groups.
    """
    small = small.withColumnRenamed(key, "_key")
    size = small.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.col("_key").cast("string"))), F.lit(0)).alias("bytes")).first()
    same = F.col(key).eqNullSafe(F.col("_key"))
    if size["n"] <= MOST_ROWS and size["bytes"] <= MOST_BYTES:
        return rows.join(F.broadcast(small), same, how).drop("_key")
    copies = small.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_deal", F.pmod(spread, F.lit(SALTS)).cast("int"))
    return dealt.join(copies, (F.col("_deal") == F.col("_copy")) & same, how).drop("_key", "_copy", "_deal")


def map_batches(df: DataFrame, setup: Callable[[], Callable], schema: pa.Schema, ddl: str) -> DataFrame:
    """Map column lists to column lists, Arrow batch by batch.

    setup() runs once a task and returns a function from a dict of Python lists to one of the
    schema's columns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = setup()
        for batch in batches:
            out = work(batch.to_pydict())
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return df.mapInArrow(run, ddl)
