"""Document fingerprints: threshold-scaled sketches of five-word shingles.

A sketch keeps every shingle hash below a threshold, a fixed fraction of the hash range: one in 2**LEAST
for all but short texts, and for those the first of 1, 1/2, 1/4 ... that keeps MOST hashes or fewer. So the
fraction depends on the set of hashes alone, and sketches merge: the merge of two sets' sketches is the
sketch of their union. Two sketches are compared below the lesser of their thresholds, where both hold every
hash: the shared hashes over the smaller side's count estimate containment, also between very unequal
documents.

Defined results: null and empty texts have the empty fingerprint, whose likeness to another empty one
is 1 and to any other 0. Texts under five words are one shingle. Repeated shingles count once, equal
texts get equal fingerprints, and texts are read whole. Where the lesser threshold leaves a side without a
hash, the likeness is 1 for equal sketches, else 0. Rows are ordered by descending doc_id, null ids last,
equal ids by a hash of the text and then the text, so that repeated rows follow each other; the only row of a
table is its own next document. An empty table gives an empty table. Other columns, of whatever name, are
ignored.
"""

from __future__ import annotations

import hashlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.storage import saved

WORDS = 5
LEAST = 4
MOST = 32
SEED = 0


def shingle_hashes(text: str | None) -> np.ndarray:
    """Hashes of a text's word shingles, distinct and ascending. Words are lower-cased and bound by white space."""
    parts = (text or "").lower().encode("utf-8", "surrogatepass").split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    digest = xxhash.xxh3_64_intdigest
    if len(parts) <= WORDS:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = list(accumulate(len(p) + 1 for p in parts))
    return np.unique(np.array([digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[WORDS - 1 :], strict=False)], np.uint64))


def _below(hashes: np.ndarray, level: int) -> np.ndarray:
    """Those of ascending hashes under the threshold of a level, 2**-level of the range."""
    return hashes[: int(np.searchsorted(hashes, np.uint64(1) << np.uint64(64 - level)))] if level else hashes


def sketch(hashes: np.ndarray, level: int = 0) -> np.ndarray:
    """The sketch of ascending distinct hashes, of which all below a level's threshold are given: its own level, then what it keeps."""
    while level < LEAST and len(_below(hashes, level)) > MOST:
        level += 1
    return np.concatenate([np.array([level], np.uint64), _below(hashes, level)])


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of both shingle sets together."""
    level = int(max(a[0], b[0]))
    return sketch(np.union1d(_below(a[1:], level), _below(b[1:], level)), level)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated containment of the smaller shingle set in the other, 0 to 1."""
    level = int(max(a[0], b[0]))
    x, y = _below(a[1:], level), _below(b[1:], level)
    least = min(len(x), len(y))
    if not least:
        return float(len(a) == len(b) and bool((a == b).all()))
    return len(np.intersect1d(x, y, assume_unique=True)) / least


def write(a: np.ndarray) -> bytes:
    """A sketch as bytes: one for its level, and eight a hash; none for the empty sketch."""
    return bytes([int(a[0])]) + a[1:].astype(">u8").tobytes() if len(a) > 1 else b""


def read(data: bytes) -> np.ndarray:
    level = np.array([data[0] if data else 0], np.uint64)
    return np.concatenate([level, np.frombuffer(data, ">u8", offset=1).astype(np.uint64)]) if data else level


def edited(text: str, after: str) -> str:
    """The text with its last third replaced by as much of the next text's beginning, or all of it."""
    k = len(text) // 3
    return text[: len(text) - k] + after[:k]


SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.binary()),
        ("edited_fingerprint", pa.binary()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
        ("part", pa.int32()),
        ("head", pa.string()),
        ("tail", pa.string()),
    ]
)
DDL = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, part int, head string, tail string"


def _row(name, text: str, own: np.ndarray, after: str, after_own: np.ndarray) -> dict:
    other = edited(text, after)
    new = sketch(shingle_hashes(other))
    return {
        "doc_id": name,
        "n_chars": len(text),
        "edited_sha256": hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(),
        "fingerprint": write(own),
        "edited_fingerprint": write(new),
        "near_edited": likeness(own, new),
        "near_next": likeness(own, after_own),
    }


def neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's fingerprint, its edited text's, and their likeness; see edited().

    The table is range-partitioned and sorted once. A task pairs each row with the one after it; a
    part's last row waits for the first of the next part that has rows. Those rows, two a part at
    most, are the only ones joined afterwards.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.withColumn("h", F.xxhash64("t"))  # ranges can part rows that share an id by it
    order = [F.desc_nulls_last("doc_id"), F.asc("h")]
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, F.asc("t")).select("doc_id", "t")

    def pairs(batches):
        part, held, head = TaskContext.get().partitionId(), None, None
        for batch in batches:
            out = []
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = sketch(shingle_hashes(t))
                if held is None:
                    head = t
                else:
                    out.append(_row(*held, t, own))
                held = (name, t, own)
            yield pa.RecordBatch.from_pylist(out, schema=SCHEMA)
        if held is not None:
            yield pa.RecordBatch.from_pylist([{"doc_id": held[0], "part": part, "head": head, "tail": held[1]}], schema=SCHEMA)

    found = saved(ordered.mapInArrow(pairs, DDL), "sketches")
    names = DDL.split(", part")[0]
    edges = found.where("part is not null").select("part", "doc_id", "head", "tail")
    line = edges.select("part").withColumn("n", F.row_number().over(Window.orderBy("part"))).withColumn("all", F.count("*").over(Window.partitionBy()))
    numbered = edges.join(F.broadcast(line), "part")
    after = numbered.select(F.when(F.col("n") == 1, F.col("all")).otherwise(F.col("n") - 1).alias("n"), F.col("head").alias("after"))
    open_rows = numbered.select("n", "doc_id", "tail").join(after, "n").select("doc_id", "tail", "after")

    def close(batches):
        for batch in batches:
            out = [_row(r["doc_id"], r["tail"], sketch(shingle_hashes(r["tail"])), r["after"], sketch(shingle_hashes(r["after"]))) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist([{k: r[k] for k in SCHEMA.names[:7]} for r in out], schema=pa.schema(list(SCHEMA)[:7]))

    closed = open_rows.mapInArrow(close, names)
    whole = found.where("part is null").select(*SCHEMA.names[:7]).unionByName(closed)
    return whole.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
