"""SimHash fingerprints and near-duplicate groups by multi-index hashing.

A fingerprint of 64 bits is cut into two segments of 32. Two fingerprints that differ in at most three
bits differ in at most one bit within one of the segments, so every distinct fingerprint is filed
under both its segments, and looks up each segment's Hamming ball of radius one (33 keys). A fetched
match is verified on all 64 bits. Crowded table keys (many fingerprints that share a whole segment)
get a second key: the other segment is cut in two again and balls of radius one within its halves are
enumerated in the same way, so that near copies do not meet all their kind. A second key leaves 16 bits
open, so at most 65,536 distinct fingerprints share one.

Groups are the connected components of the links, found by alternating large-star and small-star
steps on pre-aggregated minima; every step's edges are written to the shared folder.

Defined results: null and empty texts, and those of white space, have fingerprint zero and link like any
other. Copies share one fingerprint and are joined once, never in pairs. A group whose ids are all
null has a null component_id. Texts are read whole. A bit that is set in exactly half the hashes is 0.
An empty table gives an empty table. Other columns, of whatever name, are ignored by near_duplicates()
and kept by keep_first().
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.storage import attach, forget, map_batches, packed, row_hash, saved

SEED = 42
WORDS = 3
DISTANCE = 3
CROWDED = 64


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Majority bits of the XXH64 hashes of a text's word shingles, as an unsigned 64-bit number."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = list(accumulate(len(p) + 1 for p in parts))
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        hashes = [digest(joined, SEED)]
    else:
        hashes = [digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[words - 1 :], strict=False)]
    h = np.array(hashes, np.uint64)
    counts = np.zeros(64, np.int64)
    for first in range(0, len(h), 1 << 14):
        bits = np.unpackbits(h[first : first + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, print (a signed 64-bit number) for every row."""

    def setup():
        def work(rows):
            found = [fingerprint(t) for t in rows["t"]]
            return {"doc_id": rows["doc_id"], "print": [x - (1 << 64) if x >> 63 else x for x in found]}

        return work

    schema = pa.schema([("doc_id", pa.int64()), ("print", pa.int64())])
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("t"))
    return map_batches(rows, setup, schema, "doc_id bigint, print bigint")


def _ball(value, bits: int):
    """A segment's own value and all values at one bit from it."""
    flips = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda b: value.bitwiseXOR(F.expr("1L") * F.pow(F.lit(2), b).cast("bigint")))
    return F.concat(F.array(value), flips)


def _halves(value, bits: int):
    """The two segments of a number, each with its place."""
    mask = F.lit((1 << bits) - 1)
    return F.array(F.struct(F.lit(0).alias("seg"), F.shiftright(value, bits).bitwiseAND(mask).alias("key"), value.bitwiseAND(mask).alias("rest")), F.struct(F.lit(1).alias("seg"), value.bitwiseAND(mask).alias("key"), F.shiftright(value, bits).bitwiseAND(mask).alias("rest")))


def links(prints: DataFrame) -> DataFrame:
    """Pairs a < b of distinct fingerprints at DISTANCE bits or fewer. prints: distinct values of print."""
    filed = saved(prints.select("print", F.explode(_halves(F.col("print"), 32)).alias("s")).select("print", "s.seg", "s.key", "s.rest"), "filed")
    crowded = saved(filed.groupBy("seg", "key").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED).select("seg", "key"), "crowded")
    probes = filed.select(F.col("print").alias("a"), "seg", F.explode(_ball(F.col("key"), 32)).alias("key"))
    verified = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE) & (F.col("a") < F.col("b"))

    def pairs(df):
        return df.where(verified).select("a", "b")

    sparse = filed.join(crowded, ["seg", "key"], "left_anti").select(F.col("print").alias("b"), "seg", "key")
    plain = pairs(probes.join(sparse, ["seg", "key"]))
    # Second keys for crowded segments: the rest's two halves of 16 bits, balls of radius one again.
    dense = filed.join(crowded, ["seg", "key"], "left_semi")
    dense = dense.select(F.col("print").alias("b"), "seg", "key", F.explode(_halves(F.col("rest"), 16)).alias("s")).select("b", "seg", "key", F.col("s.seg").alias("sub"), F.col("s.key").alias("subkey"))
    rest = F.when(F.col("seg") == 0, F.col("a").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftright("a", 32).bitwiseAND(F.lit(0xFFFFFFFF)))
    again = probes.join(crowded, ["seg", "key"], "left_semi").select("a", "seg", "key", F.explode(_halves(rest, 16)).alias("s"))
    again = again.select("a", "seg", "key", F.col("s.seg").alias("sub"), F.explode(_ball(F.col("s.key"), 16)).alias("subkey"))
    deep = pairs(again.join(dense, ["seg", "key", "sub", "subkey"]))
    return plain.union(deep).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node that has an edge (a, b)."""
    now = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v")).groupBy("node").agg(F.min("root").alias("root"))
        before = state
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = saved(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m")), F.struct(F.col("v").alias("u"), F.col("m")))).alias("e")).select("e.u", F.col("e.m").alias("v"))
        after = saved(small.where("u <> v").distinct(), "edges")
        forget(now)
        forget(large)
        now = after


def groups(prints: DataFrame) -> DataFrame:
    """print, component_id for every distinct fingerprint of a saved table (doc_id, print)."""
    distinct = saved(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "distinct")
    found = components(links(distinct.select("print")))
    named = distinct.join(found.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return saved(attach(named.select("print", "root"), saved(ids, "component_ids"), "root", F.xxhash64("print")).select("print", "component_id"), "groups")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id for every row."""
    prints = saved(fingerprints(docs, doc_id, text), "prints")
    return prints.join(groups(prints), "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group, all columns: that of the least doc_id, null ids last; of equal ids the least text hash.

    Of rows equal in id and text the one with the least hash of all columns stays; tasks merge such rows
    before the shuffle, the only one of texts.
    """
    key = F.col(doc_id).cast("bigint")
    marked = docs.select(key.alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))

    def setup():
        def work(rows):
            found = [fingerprint(t) for t in rows["t"]]
            return {"doc_id": rows["doc_id"], "h": rows["h"], "print": [x - (1 << 64) if x >> 63 else x for x in found]}

        return work

    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("print", pa.int64())])
    prints = saved(map_batches(marked, setup, schema, "doc_id bigint, h bigint, print bigint"), "prints")
    grouped = saved(prints.join(_rooted(prints), "print"), "grouped")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "h"))
    kept = saved(grouped.groupBy("root").agg(first.alias("k")).select("k.none", "k.id", "k.h").distinct(), "kept")
    rows = docs.select(packed(docs), key.isNull().alias("none"), F.coalesce(key, F.lit(0)).alias("id"), F.xxhash64(text).alias("h"), row_hash(docs).alias("all"))
    one = rows.groupBy("none", "id", "h").agg(F.min_by("row", "all").alias("row"))
    return one.join(kept, ["none", "id", "h"], "left_semi").select("row.*")


def _rooted(prints: DataFrame) -> DataFrame:
    """print, root for every distinct fingerprint."""
    distinct = saved(prints.select("print").distinct(), "distinct")
    found = components(links(distinct))
    return saved(distinct.join(found.withColumnRenamed("node", "print"), "print", "left").select("print", F.coalesce("root", "print").alias("root")), "rooted")
