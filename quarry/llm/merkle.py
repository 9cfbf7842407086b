"""A Merkle manifest of a data set: a leaf a document, a tree a language, one root over all, and a proof a document.

Ranks come from a radix trie over the leaves' sort keys (hexadecimal digits of the id, then the leaf): a
histogram of key prefixes counts each bucket's leaves, buckets of more than BUCKET leaves are counted
again by longer prefixes, and the counts of a bucket's elder siblings, added to its parent's offset, say
where it begins. Only within buckets are leaves put in order. So ranks are exact without a global sort,
and neither a language nor a range of ids that holds most rows is one task's.

A leaf's rank in base FANOUT, as many digits as its tree is high, is its key in the hash trie. Nodes of the
longest keys are reduced first: those that share all digits but the last are one run, hashed to the node of the
shorter key, until the empty key is left. Trees of different heights join the reduction where their keys
get as long. Languages' subroots are ranked and reduced in the same way.

Proofs go down again: each run gets the hashes left and right of the way above it and hands its members these and
their own siblings. The tables shrink by FANOUT a level, so that all of it is as large as one list a run.

Defined results: null fields count as '-' in the leaf. Null ids come first, and are not tampered with; equal ids are
ordered by leaf, and equal leaves take the ranks that follow each other, so whole rows may repeat. A null
language has a tree of its own, the first. One leaf alone is its tree's subroot, and one tree's subroot the root,
with no siblings. Empty texts are values of 0 bytes. An empty table gives an empty table. Other columns, of
whatever name, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.storage import attach, saved

FANOUT = 8
BUCKET = 4096
DIGITS = 3
CHUNK = 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED_EVERY = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WAY = "array<struct<left:string,right:string>>"


def leaf_hash(values: list[Column]) -> Column:
    """The hash of fields: each its length in bytes and its value, or a dash."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*parts), 256)


def _id_digits(doc_id: Column) -> Column:
    """Digits in the order of signed 64-bit numbers, null first."""
    biased = F.lpad(F.hex(doc_id.bitwiseXOR(F.expr("shiftleft(1L, 63)"))), 16, "0")
    return F.when(doc_id.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), biased))


def leaves(docs: DataFrame) -> DataFrame:
    """Saved (tree, key, doc_id, leaf, other, n): distinct leaves, how often each occurs, and the hash of the tampered row where it is tampered with."""
    columns = [F.col(c) for c in FIELDS]
    text = F.col("text")
    hit = F.crc32(F.col("doc_id").cast("bigint").cast("string")) % TAMPERED_EVERY == 0
    lower = F.translate(text, _UPPER, _LOWER)
    other = F.when(hit, leaf_hash([*columns[:4], lower]))
    tree = F.when(F.col("lang").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.hex(F.col("lang").cast("binary"))))
    rows = docs.select(tree.alias("tree"), F.col("doc_id").cast("bigint").alias("doc_id"), leaf_hash(columns).alias("leaf"), other.alias("other"))
    one = rows.groupBy("tree", "doc_id", "leaf", "other").agg(F.count("*").alias("n"))
    return saved(one.withColumn("key", F.concat(_id_digits(F.col("doc_id")), F.lower("leaf"))), "leaves")


def ranked(rows: DataFrame, bucket: int = BUCKET, digits: int = DIGITS) -> DataFrame:
    """A saved table (tree, key, n, ...) with start: how many of its tree come before, by key. Keys are distinct within a tree.

    Each pass reads keys and counts only. The first prefix is ``digits`` longer than what all keys begin with.
    """
    ends = rows.agg(F.min("key").alias("a"), F.max("key").alias("b"), F.max(F.length("key")).alias("most")).first()
    if ends["a"] is None:
        return rows.withColumn("start", F.lit(0).cast("bigint"))
    same = next((i for i, (x, y) in enumerate(zip(ends["a"], ends["b"], strict=False)) if x != y), min(len(ends["a"]), len(ends["b"])))
    at, most = same + digits, ends["most"]
    whole = F.concat_ws("/", "tree", "key")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("parent").orderBy("name").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left, parents, out = rows, None, None
    while True:
        name = F.concat_ws("/", "tree", F.substring("key", 1, at))
        parent = F.col("tree") if parents is None else F.concat_ws("/", "tree", F.substring("key", 1, at - digits))
        counts = left.groupBy(parent.alias("parent"), name.alias("name")).agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
        counts = counts.withColumn("offset", before)
        if parents is not None:
            counts = counts.join(parents.select(F.col("name").alias("parent"), F.col("offset").alias("above")), "parent").withColumn("offset", F.col("offset") + F.col("above"))
        counts = saved(counts.select("name", "rows", "offset"), "buckets")
        heavy = counts.where((F.col("rows") > bucket) & (F.lit(at) < most))
        if heavy.isEmpty():
            found = attach(left.withColumn("name", name), counts.select("name", "offset"), "name", F.xxhash64(whole))
            return _inside(found) if out is None else out.unionByName(_inside(found))
        found = attach(left.withColumn("name", name), counts, "name", F.xxhash64(whole)).withColumn("deep", (F.col("rows") > bucket) & (F.lit(at) < most)).drop("rows")
        light = _inside(found.where(~F.col("deep")).drop("deep"))
        out = light if out is None else out.unionByName(light)
        left, parents, at = found.where("deep").drop("deep", "name", "offset"), heavy, at + digits


def _inside(found: DataFrame) -> DataFrame:
    """Rows (name, offset, ...) of buckets, with start; a bucket is one group, of BUCKET rows at most."""
    before = F.coalesce(F.sum("n").over(Window.partitionBy("name").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.withColumn("start", F.col("offset") + before).drop("name", "offset")


def _copies(rows: DataFrame) -> DataFrame:
    """A row a leaf: those of rows (start, n) that occur n times, with their ranks; more than CHUNK of them are made by several tasks."""
    last = F.floor((F.col("n") - 1) / CHUNK)
    few = rows.where(F.col("n") <= CHUNK).withColumn("chunk", F.lit(0).cast("bigint"))
    many = rows.where(F.col("n") > CHUNK).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).repartition("tree", "start", "chunk")
    first = F.col("start") + F.col("chunk") * CHUNK
    return few.unionByName(many).withColumn("rank", F.explode(F.sequence(first, F.least(first + CHUNK, F.col("start") + F.col("n")) - 1))).drop("chunk", "n", "start")


def keyed(rows: DataFrame) -> DataFrame:
    """Rows (tree, key, n, ...) as one row a leaf, with path: its rank in base FANOUT, as many digits as the tree is high."""
    sizes = saved(rows.groupBy("tree").agg(F.sum("n").alias("leaves")), "trees")
    height = F.when(F.col("leaves") == 1, F.lit(0)).otherwise(F.length(F.conv((F.col("leaves") - 1).cast("string"), 10, FANOUT)))
    every = attach(_copies(ranked(rows)), sizes, "tree", F.xxhash64("tree", "rank"))
    path = F.when(height == 0, F.lit("")).otherwise(F.lpad(F.conv(F.col("rank").cast("string"), 10, FANOUT), height, "0"))
    return every.withColumn("path", path).drop("leaves", "rank")


def _runs(nodes: DataFrame, *more: str) -> DataFrame:
    """Nodes (tree, path, hash, ...) to runs (tree, path, members in order): those that share all digits but the last."""
    member = F.struct(F.substring("path", -1, 1).alias("digit"), "hash", *more)
    return nodes.groupBy("tree", F.expr("substring(path, 1, length(path) - 1)").alias("path")).agg(F.sort_array(F.collect_list(member)).alias("members"))


def _hashed(runs: DataFrame) -> DataFrame:
    return runs.select("tree", "path", F.sha2(F.array_join(F.transform("members", lambda m: m["hash"]), ""), 256).alias("hash"))


class Tree:
    """Runs of leaves, runs of nodes by the length of their key, and a subroot a tree; all saved."""

    def __init__(self, rows: DataFrame, *more: str):
        nodes = keyed(rows)
        at = F.length("path")
        self.lone = saved(nodes.where(at == 0), "lone")
        self.runs = saved(_runs(nodes.where(at > 0), *more), "runs")
        height = self.runs.agg(F.max(F.length("path"))).first()[0]
        base, self.inner = saved(_hashed(self.runs), "nodes"), {}
        now = None
        for w in range(height if height is not None else 0, 0, -1):
            level = base.where(at == w)
            level = level if now is None else level.unionByName(_hashed(now))
            now = self.inner[w] = saved(_runs(level), "nodes")
        tops = self.lone.select("tree", "hash").unionByName(base.where(at == 0).select("tree", "hash"))
        self.roots = saved(tops if now is None else tops.unionByName(_hashed(now).select("tree", "hash")), "roots")

    def ways(self, tops: DataFrame, *more: str) -> DataFrame:
        """Leaves with their hash, columns ``more`` and way: the hashes to their left and right at each level, upwards. tops: (tree, way, ...) of roots."""
        kept = [c for c in tops.columns if c not in ("tree", "way")]
        above = tops.withColumn("path", F.lit(""))
        every = above
        for w in sorted(self.inner):
            above = saved(_below(self.inner[w], above, kept).select("tree", "path", *kept, "way"), "ways")
            every = every.unionByName(above, allowMissingColumns=True)
        down = _below(self.runs, every, kept, *more).drop("tree", "path")
        alone = attach(self.lone.select("tree", "hash", *more), tops, "tree", F.xxhash64("hash"))
        return down.unionByName(alone.drop("tree"), allowMissingColumns=True)


def _below(runs: DataFrame, above: DataFrame, kept: list[str], *more: str) -> DataFrame:
    """The members of runs, each with its own siblings before the way of its run."""
    hashes = F.transform("members", lambda m: m["hash"])
    rows = runs.join(above, ["tree", "path"]).select("tree", "path", *kept, "way", "members", hashes.alias("hashes"), F.posexplode("members").alias("at", "m"))
    left, right = F.array_join(F.slice("hashes", 1, F.col("at")), ""), F.array_join(F.slice("hashes", F.col("at") + 2, FANOUT), "")
    own = F.array(F.struct(left.alias("left"), right.alias("right")))
    return rows.select("tree", F.concat("path", "m.digit").alias("path"), *kept, F.concat(own, F.col("way")).alias("way"), "m.hash", *[F.col(f"m.{c}").alias(c) for c in more])


def folded(leaf: Column, way: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(way, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row."""
    made = leaves(docs)
    whole = Tree(made.withColumnRenamed("leaf", "hash"), "doc_id", "other")
    subroots = whole.roots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), F.col("tree").alias("of"), F.lit(1).cast("bigint").alias("n"), "hash")
    upper = Tree(saved(subroots, "subroots"), "of")
    none = F.array().cast(_WAY).alias("way")
    tops = saved(upper.ways(upper.roots.select("tree", F.col("hash").alias("root"), none), "of").select(F.col("of").alias("tree"), "root", "way", F.col("hash").alias("subroot")), "tops")
    rows = whole.ways(tops, "doc_id", "other")
    siblings = F.array_join(F.transform("way", lambda s: F.concat(s["left"], s["right"])), "")
    rows = rows.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded(F.coalesce("other", "hash"), F.col("way")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
