"""Token ids in patched frame-of-reference files.

A file image holds the ids of whole documents, one after another, in blocks of 128. Each block
subtracts its minimum, packs every value's low bits at the width that a percentile of the block's
values needs, and lists the others as exceptions: their places and remaining high bits. An index of
block starts lets a reader fetch any block alone.

Layout, little-endian: magic "QPF1"; u32 values; u32 blocks; the index, u32 start of each block's
packed bits and their end; u32 minimum of each block; u8 width of each; u8 number of exceptions of
each; the packed bits (16 bytes a bit of width); u8 place of each exception; u32 high bits of each.

Images are rows of a Parquet table in the shared folder, so that Spark's committer writes and reads
them on any store and a lost executor's part is written again: part and number give the order, and
doc_ids and sizes list the documents. Parts are ranges of doc_id.

Defined results: null and empty texts write the end id alone. Null ids come first; rows that share a
doc_id follow each other by a hash of the text, which also parts them into ranges, and then by the text.
Texts of any length are written whole, a file image growing as needed. Repeated rows are written as often
as they stand. An empty table gives an empty table. Other columns, of whatever name, are ignored.
"""

from __future__ import annotations

import zlib
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.bpe import Encoder, Vocabulary, byte_characters
from quarry.llm.storage import saved

MAGIC = b"QPF1"
BLOCK = 128
PERCENTILE = 90
END_ID = 1
IMAGE_IDS = 1 << 16


def pack(values: np.ndarray) -> bytes:
    """A file image of unsigned 32-bit values."""
    n = len(values)
    blocks = -(-n // BLOCK)
    whole = np.zeros(blocks * BLOCK, np.int64)
    whole[:n] = values
    whole[n:] = values[-1] if n else 0
    table = whole.reshape(blocks, BLOCK)
    low = table.min(axis=1, initial=1 << 32)
    delta = (table - low[:, None]).astype(np.uint32)
    need = np.frexp(delta.astype(np.float64))[1].astype(np.uint8)  # bits of each value
    width = np.partition(need, BLOCK * PERCENTILE // 100 - 1, axis=1)[:, BLOCK * PERCENTILE // 100 - 1].astype(np.int64)
    odd = need > width[:, None]
    starts = np.concatenate([[0], np.cumsum(16 * width)])
    body = np.zeros(starts[-1], np.uint8)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        bits = np.unpackbits(delta[rows].astype("<u4").view(np.uint8).reshape(len(rows), BLOCK, 4)[:, :, : -(-w // 8)], axis=2, bitorder="little")[:, :, :w]
        body[starts[rows][:, None] + np.arange(16 * w)] = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
    row, place = np.nonzero(odd)
    high = delta[row, place] >> width[row].astype(np.uint32)
    parts = (starts.astype("<u4"), low.astype("<u4"), width.astype(np.uint8), odd.sum(axis=1).astype(np.uint8), body, place.astype(np.uint8), high.astype("<u4"))
    return MAGIC + np.array([n, blocks], "<u4").tobytes() + b"".join(p.tobytes() for p in parts)


def unpack(image: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The values of blocks first to last (all by default), found by the index of block starts."""
    if image[:4] != MAGIC:
        raise ValueError("not a token file image")
    n, blocks = (int(x) for x in np.frombuffer(image, "<u4", 2, 4))
    last = blocks if last is None else min(last, blocks)
    at = 12
    starts = np.frombuffer(image, "<u4", blocks + 1, at).astype(np.int64)
    at += 4 * (blocks + 1)
    low = np.frombuffer(image, "<u4", blocks, at)
    at += 4 * blocks
    width, count = np.frombuffer(image, np.uint8, blocks, at).astype(np.int64), np.frombuffer(image, np.uint8, blocks, at + blocks).astype(np.int64)
    at += 2 * blocks
    body = np.frombuffer(image, np.uint8, int(starts[-1]), at)
    at += int(starts[-1])
    places = np.frombuffer(image, np.uint8, int(count.sum()), at)
    high = np.frombuffer(image, "<u4", len(places), at + len(places))
    out = np.zeros((max(0, last - first), BLOCK), np.uint32)
    for w in np.unique(width[first:last]).tolist():
        rows = np.flatnonzero(width[first:last] == w)
        bits = np.unpackbits(body[starts[first + rows][:, None] + np.arange(16 * w)], axis=1, bitorder="little").reshape(len(rows), BLOCK, w)
        value = np.zeros((len(rows), BLOCK), np.uint32)
        for k in range(w):
            value |= bits[:, :, k].astype(np.uint32) << np.uint32(k)
        out[rows] = value
    begin, end = int(count[:first].sum()), int(count[:last].sum())
    row = np.repeat(np.arange(max(0, last - first)), count[first:last])
    out[row, places[begin:end]] |= high[begin:end] << width[first + row].astype(np.uint32)
    out += low[first:last, None]
    return out.reshape(-1)[: n - first * BLOCK if last == blocks else None].astype(np.int64)


def library_words(path: str):
    """Ids of words by the tokenizers library's model of a vocabulary file."""
    from tokenizers import Tokenizer

    get = attrgetter("id")
    tokenize, shown = Tokenizer.from_file(path).model.tokenize, dict(enumerate(byte_characters()))

    def encode(words: list[str]) -> list[list[int]]:
        visible = (w if w.isascii() and w.isalpha() else w.encode().decode("latin-1").translate(shown) for w in words)
        return [list(map(get, found)) for found in map(tokenize, visible)]

    return encode


def write(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode documents in ascending doc_id order into file images, saved in the shared folder."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("t"))
    rows = rows.withColumn("h", F.xxhash64("t"))  # ranges can part rows that share an id by it
    ordered = rows.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h", "t").select("doc_id", "t")
    schema = pa.schema([("part", pa.int32()), ("number", pa.int64()), ("first", pa.int64()), ("image", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])

    def images(batches):
        part = TaskContext.get().partitionId()
        encoder = Encoder(Vocabulary(path), library_words(path))
        ids, held, doc_ids, sizes, number, first = [], 0, [], [], 0, 0

        def row():
            stream = np.concatenate(ids) if ids else np.zeros(0, np.int64)
            return pa.RecordBatch.from_pylist([{"part": part, "number": number, "first": first, "image": pack(stream), "doc_ids": doc_ids, "sizes": sizes}], schema=schema)

        for batch in batches:
            names = batch.column(0).to_pylist()
            for name, found in zip(names, encoder.encode_all(batch.column(1)), strict=True):
                ids += [found, np.array([END_ID])]
                doc_ids.append(name)
                sizes.append(len(found) + 1)
                held += sizes[-1]
                if held >= IMAGE_IDS:
                    yield row()
                    ids, doc_ids, sizes, number, first, held = [], [], [], number + 1, first + held, 0
        if doc_ids:
            yield row()

    return saved(ordered.mapInArrow(images, "part int, number bigint, first bigint, image binary, doc_ids array<bigint>, sizes array<bigint>"), "token_files")


def read(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files.

    A part's images carry their place in the part; the parts' own sizes add up to the rest. Those are one row
    a part, at most spark.sql.shuffle.partitions rows, and so may go to every task.
    """
    totals = files.groupBy("part").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n"))
    offsets = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("begin", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def documents(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids = unpack(r["image"]).astype("<u4")
                ends = np.cumsum(r["sizes"])
                begins = ends - r["sizes"]
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                n = len(crcs)
                yield pa.RecordBatch.from_arrays([pa.array([r["part"]] * n, pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array(begins + r["first"], pa.int64()), pa.array(r["sizes"], pa.int64()), pa.array(crcs, pa.int64())], schema=schema)

    found = files.select("part", "first", "image", "doc_ids", "sizes").mapInArrow(documents, "part int, doc_id bigint, begin bigint, n_tokens bigint, ids_crc32 bigint")
    return found.join(F.broadcast(offsets), "part").select("doc_id", (F.col("begin") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
