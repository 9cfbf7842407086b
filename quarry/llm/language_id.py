"""Language identification by compression.

Every language gets a raw-content dictionary for zstandard, cut from a bounded sample of labelled
texts. A text, folded to lower-case letters and single spaces, is compressed block by block with each
dictionary; the language whose dictionary gives the fewest bytes wins. A narrow margin between the
best two sizes rejects the text.

Defined results: a null text or one without a letter gets ``und``, score 0 and is rejected. Equal
sizes go to the first language by code point, with margin 0. Whole texts are read, of any length.
Repeated rows get equal answers, and copies of a text teach once. With no labelled row every text is
``und``; an empty table gives an empty table. Columns beyond the id and the text, of whatever name, are
ignored by identify() and kept by keep_identified().
"""

from __future__ import annotations

import math

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.storage import map_batches, saved

LEVEL = 9
BLOCK = 4096
DICTIONARY_BYTES = 32 * 1024
SAMPLE_TEXTS = 900
SAMPLE_CHARS = 600
MAX_LANGUAGES = 500
MIN_MARGIN = 0.002
UNKNOWN = "und"

_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")


def fold(text: str | None) -> str:
    """Lower-case letters with single spaces between and around words; empty without a letter."""
    words = _NOT_LETTERS.sub(" ", text or "").strip().lower()
    return f" {words} " if regex.search(r"\p{L}", words) else ""


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Dictionaries of DICTIONARY_BYTES at most, one a language.

    The sample is bounded: of each language's distinct texts with a letter the SAMPLE_TEXTS of least hash, a
    slice of SAMPLE_CHARS each, from a place in the text that the hash chooses. Only hashes are shuffled to
    choose them; a task sends SAMPLE_TEXTS a language at most. Rows without text or language teach nothing.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(text).alias("t"), F.col(lang).alias("l"), F.xxhash64(text).alias("h"))
    hashes = saved(rows.groupBy("l", "h").agg(F.lit(1).alias("one")).select("l", "h"), "text_hashes")
    counts = {r["l"]: r["n"] for r in hashes.groupBy("l").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; pass a coarser label")
    if not counts:
        return {}
    # Some 4 * SAMPLE_TEXTS hashes of each language are low enough to be ranked, so that no task ranks more.
    bounds = [(k, int(min(1.0, 4 * SAMPLE_TEXTS / n) * 2**64) - 2**63 - 1) for k, n in counts.items()]
    low = hashes.join(F.broadcast(labelled.sparkSession.createDataFrame(bounds, "l string, bound bigint")), "l").where("h <= bound")
    least = Window.partitionBy("l").orderBy("h")
    chosen = low.withColumn("n", F.row_number().over(least)).where(F.col("n") <= SAMPLE_TEXTS).select("l", "h")
    start = F.pmod(F.shiftright("h", 20), F.greatest(F.lit(1), F.length("t") - SAMPLE_CHARS)).cast("int") + 1
    picked = (
        rows.join(F.broadcast(chosen), ["l", "h"])  # MAX_LANGUAGES * SAMPLE_TEXTS rows of two values at most
        .select("l", "h", F.substring("t", start, F.lit(SAMPLE_CHARS)).alias("part"))
        .groupBy("l", "h")
        .agg(F.min("part").alias("part"))  # copies share a hash: one slice, however many there are
    )
    parts: dict[str, dict[int, str]] = {k: {} for k in counts}
    for row in picked.toLocalIterator():
        parts[row["l"]][row["h"]] = row["part"]
    out = {}
    for k, found in parts.items():
        body = b"".join(fold(found[h]).encode() for h in sorted(found))
        if body:
            out[k] = body[:DICTIONARY_BYTES]
    return out


def compressors(dictionaries: dict[str, bytes]) -> dict[str, zstandard.ZstdCompressor]:
    out = {}
    for k in sorted(dictionaries):
        words = zstandard.ZstdCompressionDict(dictionaries[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(level=LEVEL)
        out[k] = zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False)
    return out


def classify(text: str | None, encoders: dict[str, zstandard.ZstdCompressor]) -> tuple[str, float, float]:
    """(language, score, margin): margin is how many more bytes the second language takes, as a share."""
    body = fold(text).encode()
    if not body or not encoders:
        return UNKNOWN, 0.0, 0.0
    blocks = [body[i : i + BLOCK] for i in range(0, len(body), BLOCK)]
    sizes = {k: sum(len(c.compress(b)) for b in blocks) for k, c in encoders.items()}
    best = min(sizes, key=lambda k: (sizes[k], k))
    rest = [v for k, v in sizes.items() if k != best]
    margin = (min(rest) - sizes[best]) / sizes[best] if rest else 1.0
    score = 1 / (1 + sum(math.exp(-60 * (v - sizes[best]) / sizes[best]) for v in rest))
    return best, score, margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, margin, rejected for every row."""
    kind = docs.schema[doc_id].dataType
    shipped = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def setup():
        encoders = compressors(shipped.value)

        def work(rows):
            found = [classify(t, encoders) for t in rows["t"]]
            return {
                "doc_id": rows["doc_id"],
                "lang_pred": [x[0] for x in found],
                "score": [x[1] for x in found],
                "margin": [x[2] for x in found],
                "rejected": [x[0] == UNKNOWN or x[2] < MIN_MARGIN for x in found],
            }

        return work

    ids = pa.int64() if kind.simpleString() in ("bigint", "int") else pa.string()
    schema = pa.schema([("doc_id", ids), ("lang_pred", pa.string()), ("score", pa.float64()), ("margin", pa.float64()), ("rejected", pa.bool_())])
    ddl = f"doc_id {'bigint' if ids == pa.int64() else 'string'}, lang_pred string, score double, margin double, rejected boolean"
    return map_batches(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")), setup, schema, ddl)


def keep_identified(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose language is found; rejected rows go."""
    shipped = docs.sparkSession.sparkContext.broadcast(dictionaries)
    place = docs.columns.index(text)

    def keep(batches):
        encoders = compressors(shipped.value)
        for batch in batches:
            mask = []
            for t in batch.column(place).to_pylist():
                found = classify(t, encoders)
                mask.append(found[0] != UNKNOWN and found[2] >= MIN_MARGIN)
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).mapInArrow(keep, docs.schema)  # by place: names may hold dots
