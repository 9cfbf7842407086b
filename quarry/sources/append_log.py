"""A run log whose records set a value or append one to a list, with compaction.

Every write is a folder of its own under ``appends``, complete once Spark has put its _SUCCESS there, so that writers
never meet. A record is (key, field, seq, op, value): ``set`` keeps the value of the highest seq, ``append`` adds to
the field's list, in the order of seq and then value. Reading folds the last compaction and all writes that it does not hold.

compact() folds what is complete when it starts into a table of BUCKETS buckets by key, then commits by creating the next
manifest, which names that table and the writes it holds. Creating a file that is there fails, so of two compactors
one wins and the other's table is never seen; a write that comes meanwhile is in no manifest and is read on. Folding
is partial in each task, and a key's list travels as its own values only.

Defined results: a key that was only appended to has null for fields that were set, and the reverse. Null values are values like any other.
Records equal in seq keep the least value for ``set``, and all of them for ``append``. Null keys are dropped. An empty log gives an empty table.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "key bigint, field string, seq bigint, op string, value double"
FOLDED = "key bigint, field string, op string, items array<struct<seq:bigint,value:double>>"
BUCKETS = 16


class AppendLog:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    # Folders and small files, by the file system that the path names.

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _list(self, folder: str) -> list[str]:
        fs, p = self._fs(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _complete(self) -> list[str]:
        out = []
        for name in self._list("appends"):
            fs, p = self._fs(f"{self.path}/appends/{name}/_SUCCESS")
            if fs.exists(p):
                out.append(name)
        return out

    def _manifest(self) -> tuple[int, dict]:
        names = [n for n in self._list("manifests") if n.endswith(".json")]
        if not names:
            return 0, {"table": None, "holds": []}
        fs, p = self._fs(f"{self.path}/manifests/{names[-1]}")
        stream = fs.open(p)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return int(names[-1].removesuffix(".json")), json.loads(text)

    # Writing.

    def append(self, rows: DataFrame, field: str, key: str = "key", seq: str = "seq", value: str = "value") -> None:
        """Add each row's value to its key's list of that field."""
        self._write(rows, field, "append", key, seq, value)

    def set(self, rows: DataFrame, field: str, key: str = "key", seq: str = "seq", value: str = "value") -> None:
        """Set each row's value as its key's field; the highest seq stays."""
        self._write(rows, field, "set", key, seq, value)

    def _write(self, rows: DataFrame, field: str, op: str, key: str, seq: str, value: str) -> None:
        made = rows.select(F.col(key).cast("bigint").alias("key"), F.lit(field).alias("field"), F.col(seq).cast("bigint").alias("seq"), F.lit(op).alias("op"), F.col(value).cast("double").alias("value"))
        made.where("key is not null").write.parquet(f"{self.path}/appends/{uuid.uuid4().hex}")

    # Reading.

    @staticmethod
    def _fold(parts: DataFrame) -> DataFrame:
        """Of (key, field, op, items): one row a key, field and operation; of ``set`` the record of the highest seq only."""
        sets = parts.where("op = 'set'").select("key", "field", "op", F.explode("items").alias("i"))
        last = sets.groupBy("key", "field", "op").agg(F.max_by(F.struct(F.col("i.seq").alias("seq"), F.col("i.value").alias("value")), F.struct(F.col("i.seq"), -F.col("i.value"))).alias("i"))
        appends = parts.where("op = 'append'").groupBy("key", "field", "op").agg(F.array_sort(F.flatten(F.collect_list("items"))).alias("items"))
        return last.select("key", "field", "op", F.array("i").alias("items")).unionByName(appends)

    def _folded(self, manifest: dict, names: list[str]) -> DataFrame:
        new = [f"{self.path}/appends/{n}" for n in names if n not in set(manifest["holds"])]
        records = self.spark.read.schema(RECORD).parquet(*new) if new else self.spark.createDataFrame([], RECORD)
        parts = records.select("key", "field", "op", F.array(F.struct("seq", "value")).alias("items"))
        if manifest["table"]:
            parts = parts.unionByName(self.spark.read.schema(f"{FOLDED}, bucket int").parquet(f"{self.path}/tables/{manifest['table']}").drop("bucket"))
        return self._fold(parts)

    def read(self) -> DataFrame:
        """key, field, value (of what was set), items (what was appended, in order)."""
        _, manifest = self._manifest()
        folded = self._folded(manifest, self._complete())
        value = F.max(F.when(F.col("op") == "set", F.get("items", F.lit(0))["value"])).alias("value")
        items = F.first(F.when(F.col("op") == "append", F.transform("items", lambda x: x["value"])), ignorenulls=True).alias("items")
        return folded.groupBy("key", "field").agg(value, items)

    # Compaction.

    def compact(self) -> bool:
        """Fold what is complete now; False if another compaction came first."""
        n, manifest = self._manifest()
        names = self._complete()
        table = uuid.uuid4().hex
        made = self._folded(manifest, names).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int"))
        made.repartition(self.buckets, "bucket").write.partitionBy("bucket").parquet(f"{self.path}/tables/{table}")
        held = sorted(set(manifest["holds"]) & set(names) | set(names))
        return self._commit(n + 1, {"table": table, "holds": held})

    def _commit(self, n: int, manifest: dict) -> bool:
        fs, p = self._fs(f"{self.path}/manifests/{n:012d}.json")
        try:
            stream = fs.create(p, False)
        except Exception:
            if fs.exists(p):
                return False
            raise
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        return True

    def clean(self) -> None:
        """Delete writes that the last manifest holds, and tables and manifests of earlier ones; for when no reader of them is left."""
        n, manifest = self._manifest()
        gone = [f"appends/{x}" for x in self._list("appends") if x in set(manifest["holds"])]
        gone += [f"tables/{x}" for x in self._list("tables") if x != manifest["table"]]
        gone += [f"manifests/{x}" for x in self._list("manifests") if x.endswith(".json") and int(x.removesuffix(".json")) < n]
        for name in gone:
            fs, p = self._fs(f"{self.path}/{name}")
            fs.delete(p, True)
