"""The prefix trie of conversations, from a global sort of their turns.

A turn becomes a token of 20 bytes: a digest of its role and text, and the text's length. A conversation is the
string of its tokens, so that byte order is the order of turn arrays and a common prefix is a common
beginning. Strings are range-sorted by (tokens, conv_id), equal ones too, so that neither a third of all
conversations that are alike nor a prefix that all share is one task's. Each task sweeps its range once
with a stack of open nodes: the longest common prefix with the string before says which of them end,
and a node that ends adds its counts to the one below it.

Nodes on the path of a range's first string may have begun in an earlier range, those on the path of its last string
may go on in a later one. They leave the task as fragments, one record a range, and one sweep over these
records stitches the open stacks together. Children whose parent is a fragment get its smallest
member from a table of fragments, sent to every task under a checked size, else salted.

A node's digest of the members that end there is taken by the task that holds them; only for nodes cut by
a range's end do the ids travel, as text, and are hashed in order as a stream.

Defined results: rows without conv_id take no part. Turns are ordered by turn, nulls first; turns of equal number by
their tokens, repeated rows being turns like any other. Null role and text are empty. The remainder of
a negative id has its sign, as in SQL. A conversation of null or no turns of its own is a member of the root.
An empty table has no root. Two turns count as equal if their digests (128 bits) and lengths are. Other columns
are ignored. A conversation's tokens are one value: 20 bytes a turn. The record of a range holds its first and last strings.
"""

from __future__ import annotations

import hashlib
import math
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.storage import attach, saved

TOKEN = 20
FAMILY = 100
MOST_SHARED = 6
RANGE_TURNS = 200_000
LEAST_TURNS = 4_000
ENDS_CHUNK = 4096
NOBODY = (1 << 63) - 1

_NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"
#: kind 0: a whole node; 1: one whose parent is the fragment ``pid``; 2: the open stacks of a range; 3: members that end at the fragment ``pid``.
_SWEPT = f"kind int, {_NODE}, ends_sha256 string, pid bigint, seq int, ends binary, first binary, last binary, fragments array<bigint>"
#: kind 0: a node made of fragments; 1: the node ``nid`` that the fragment ``pid`` belongs to.
_STITCHED = f"kind int, {_NODE}, nid bigint, pid bigint"
_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (c.split(" ", 1) for c in ddl.split(", "))])


class Rows:
    """Rows of named values, handed on as record batches."""

    def __init__(self, schema: pa.Schema, most: int = 5000):
        self.schema, self.most = schema, most
        self.columns = {f.name: [] for f in schema}
        self.n = 0

    def add(self, **values) -> None:
        for name, column in self.columns.items():
            column.append(values.get(name))
        self.n += 1

    def full(self) -> bool:
        return self.n >= self.most

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(self.columns[f.name], f.type) for f in self.schema], schema=self.schema)
        self.columns = {f.name: [] for f in self.schema}
        self.n = 0
        return out


def rebuilt(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Saved (conv_id, key): every conversation's tokens, after its first turns are those of its family's first conversation."""
    r, t = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    token = F.concat(F.md5(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t)), F.lpad(F.hex(F.length(t)), 8, "0"))
    turns = conversations.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("bigint").alias("conv_id"), F.struct(F.col(turn).alias("turn"), token.alias("token")).alias("t"))
    tokens = F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda x: x["token"]), "")
    own = saved(turns.groupBy("conv_id").agg(F.unhex(tokens).alias("own")), "turns")
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = own.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.substring("own", 1, TOKEN * MOST_SHARED).alias("head"))
    size = TOKEN * (F.crc32(F.col("conv_id").cast("string")) % MOST_SHARED).cast("int")
    key = F.concat(F.coalesce(F.substring("head", F.lit(1), size), F.lit(b"")), F.substring("own", size + 1, F.length("own")))
    return saved(own.withColumn("base", base).join(heads, "base", "left").select("conv_id", key.alias("key")), "rebuilt")


def common_turns(a: bytes, b: bytes) -> int:
    """The number of turns that two token strings begin with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // TOKEN
    low, high = 0, n  # a[:low] is alike, a[:high] is not
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low // TOKEN


def _length(key: bytes, depth: int) -> int:
    return int.from_bytes(key[depth * TOKEN - 4 : depth * TOKEN], "big") if depth else 0


def _ids(ends: array) -> bytes:
    return ",".join(map(str, ends)).encode()


class Node:
    __slots__ = ("conv", "n", "children", "leaves", "saved", "ends", "waiting", "pid", "pids")

    def __init__(self, pid: int | None = None):
        self.conv, self.n, self.children, self.leaves, self.saved = NOBODY, 0, 0, 0, 0
        self.ends, self.waiting = array("q"), []
        self.pid, self.pids = pid, []

    def take(self, conv: int, n: int, children: int, leaves: int, saved_: int) -> None:
        self.conv, self.n = min(self.conv, conv), self.n + n
        self.children, self.leaves, self.saved = self.children + children, self.leaves + leaves, self.saved + saved_

    def counted(self, key: bytes, depth: int) -> dict:
        leaves = self.leaves if self.children else 1
        return {"conv_id": self.conv, "depth": depth, "n_convs": self.n, "n_children": self.children, "n_leaves": leaves, "saved_tokens": self.saved + (self.n - 1) * _length(key, depth)}


class Sweep:
    """The stack over one sorted range. Nodes on its first string's path, and those open at its end, become fragments."""

    def __init__(self, part: int, rows: Rows):
        self.part, self.rows, self.serial = part, rows, part << 32
        self.stack: list[Node] = []
        self.first = self.last = None
        self.fragments: list[int] = []

    def _pid(self) -> int:
        self.serial += 1
        return self.serial

    def add(self, conv: int, key: bytes) -> None:
        if self.first is None:
            self.first = key
            self.stack = [Node(self._pid()) for _ in range(len(key) // TOKEN + 1)]
        elif key != self.last:
            shared = common_turns(self.last, key)
            self._close(shared)
            self.stack += [Node() for _ in range(len(key) // TOKEN - shared)]
        self.last = key
        top = self.stack[-1]
        top.take(conv, 1, 0, 0, 0)
        top.ends.append(conv)

    def _close(self, depth: int) -> None:
        while len(self.stack) - 1 > depth:
            at, node = len(self.stack) - 1, self.stack.pop()
            if node.pid is not None:
                self._fragment(node, at, 0)
                continue
            for child in node.waiting:
                self.rows.add(kind=0, parent_conv_id=node.conv, **child)
            own = node.counted(self.last, at)
            below = self.stack[-1]
            below.take(own["conv_id"], own["n_convs"], 1, own["n_leaves"], own["saved_tokens"])
            own["ends_sha256"] = hashlib.sha256(_ids(node.ends)).hexdigest()
            if below.pid is not None:
                self.rows.add(kind=1, pid=below.pid, **own)
            else:
                below.waiting.append(own)

    def _fragment(self, node: Node, depth: int, side: int) -> None:
        """side 0: may have begun before; 1: may go on; 2: both."""
        for child in node.waiting:
            self.rows.add(kind=1, pid=node.pid, **child)
        for seq, first in enumerate(range(0, len(node.ends), ENDS_CHUNK)):
            self.rows.add(kind=3, pid=node.pid, seq=seq, ends=_ids(node.ends[first : first + ENDS_CHUNK]))
        self.fragments += [side, depth, node.pid, node.conv, node.n, node.children, node.leaves, node.saved]

    def end(self) -> None:
        for depth, node in enumerate(self.stack):
            side = 1 if node.pid is None else 2
            node.pid = self._pid() if node.pid is None else node.pid
            self._fragment(node, depth, side)
        self.rows.add(kind=2, pid=self.part, first=self.first, last=self.last, fragments=self.fragments)


class Stitch:
    """The stack over the ranges' records, in order."""

    def __init__(self, rows: Rows):
        self.rows, self.stack, self.key, self.nid = rows, [], b"", 0

    def add(self, first: bytes, last: bytes, fragments: list[int]) -> None:
        left, right = {}, {}
        for at in range(0, len(fragments), 8):
            side, depth, *rest = fragments[at : at + 8]
            (right if side == 1 else left)[depth] = rest
        if self.stack:
            self._close(common_turns(self.key, first))
        self.key = first
        self._path(left, 0, len(first) // TOKEN)
        shared = common_turns(first, last)
        self._close(shared)
        self.key = last
        self._path(right, shared + 1, len(last) // TOKEN)

    def _path(self, fragments: dict, low: int, high: int) -> None:
        for depth in range(low, high + 1):
            if depth == len(self.stack):
                self.stack.append(Node())
            pid, *counts = fragments[depth]
            self.stack[depth].take(*counts)
            self.stack[depth].pids.append(pid)

    def _close(self, depth: int) -> None:
        while len(self.stack) - 1 > depth:
            at, node = len(self.stack) - 1, self.stack.pop()
            for child in node.waiting:
                self.rows.add(kind=0, parent_conv_id=node.conv, **child)
            self.nid += 1
            for pid in node.pids:
                self.rows.add(kind=1, pid=pid, nid=self.nid, conv_id=node.conv)
            own = node.counted(self.key, at) | {"nid": self.nid}
            if self.stack:
                self.stack[-1].take(own["conv_id"], own["n_convs"], 1, own["n_leaves"], own["saved_tokens"])
                self.stack[-1].waiting.append(own)
            else:
                self.rows.add(kind=0, **own)

    def end(self) -> None:
        self._close(-1)


def _swept(sorted_rows: DataFrame) -> DataFrame:
    """Rows (part, conv_id, key), sorted in each partition, to what their sweep gives."""
    schema = _schema(_SWEPT)

    def run(batches):
        rows, sweep = Rows(schema), None
        for batch in batches:
            for part, conv, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sweep is None:
                    sweep = Sweep(part, rows)
                sweep.add(conv, key)
                if rows.full():
                    yield rows.batch()
        if sweep is not None:
            sweep.end()
            yield rows.batch()

    return sorted_rows.mapInArrow(run, _SWEPT)


def _stitched(records: DataFrame) -> DataFrame:
    """One record a range, in the order of ranges, to the nodes that their fragments make."""
    schema = _schema(_STITCHED)

    def run(batches):
        rows = Rows(schema)
        stitch = Stitch(rows)
        for batch in batches:
            for _, first, last, fragments in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                stitch.add(first, last, fragments)
                if rows.full():
                    yield rows.batch()
        stitch.end()
        yield rows.batch()

    return records.select("pid", "first", "last", "fragments").repartition(1).sortWithinPartitions("pid").mapInArrow(run, _STITCHED)


def _digests(chunks: DataFrame) -> DataFrame:
    """nid, ends_sha256 of chunks (nid, pid, seq, ends) of decimal ids, hashed in order as a stream."""
    schema = pa.schema([("nid", pa.int64()), ("ends_sha256", pa.string())])

    def run(batches):
        now, digest = None, None
        for batch in batches:
            out = []
            for nid, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if nid != now:
                    if now is not None:
                        out.append((now, digest.hexdigest()))
                    now, digest = nid, hashlib.sha256(ends)
                else:
                    digest.update(b"," + ends)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(schema)], schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([digest.hexdigest()])], schema=schema)

    ordered = chunks.repartition("nid").sortWithinPartitions("nid", "pid", "seq").select("nid", "ends")
    return ordered.mapInArrow(run, "nid bigint, ends_sha256 string")


def trie(keys: DataFrame, ranges: int | None = None) -> DataFrame:
    """Every node of the trie of a saved table (conv_id, key). ranges: how many to sort into, by default by the number of turns."""
    spark = keys.sparkSession
    if ranges is None:
        turns = keys.agg(F.sum(F.length("key") / TOKEN + 1).alias("n")).first()["n"] or 0
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ranges = max(1, min(parts, math.ceil(turns / LEAST_TURNS)), math.ceil(turns / RANGE_TURNS))
    ordered = keys.repartitionByRange(ranges, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    swept = saved(_swept(ordered.select(F.spark_partition_id().alias("part"), "conv_id", "key")), "swept")
    stitched = saved(_stitched(swept.where("kind = 2")), "stitched")
    owner = saved(stitched.where("kind = 1").select("pid", "nid", F.col("conv_id").alias("owner")), "fragments")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    late = attach(swept.where("kind = 1").drop("parent_conv_id"), owner, "pid", F.xxhash64("conv_id", "depth")).withColumn("parent_conv_id", F.col("owner"))
    chunks = attach(swept.where("kind = 3").select("pid", "seq", "ends"), owner.select("pid", "nid"), "pid", F.col("seq"))
    digests = saved(_digests(chunks), "digests")
    cut = stitched.where("kind = 0").join(digests, "nid", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    return swept.where("kind = 0").select(columns).unionByName(late.select(columns)).unionByName(cut.select(columns))


def prefix_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of the rebuilt conversations."""
    return trie(rebuilt(conversations, conv_id, turn, role, text))
