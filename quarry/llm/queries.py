"""The operators' queries over whole tables, with production parameters, and SQL forms where there are some."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, language_id, license_scan, merkle, mixing, nearest, oracle, personal_data, prefix_trie, simhash, sketch, subword_softmax, token_files
from quarry.llm.storage import document_table, remainder

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
QUALITY = subword_softmax.Settings(lower=False, pairs=True, documents=4000, characters=14_000_000, epochs=6)
#: doubt was chosen among 0 to 4 by the errors on a fifth of the rows that may be learned (remainder 1), learning the other three, over tables of all sizes.
TOXIC = subword_softmax.Settings(documents=5000, characters=16_000_000, epochs=6, doubt=2.0, shift=False, least=2)


def _held_out(n: int, held: int) -> Column:
    """Whether a row's id falls in the held-out part; an id that is null does not, and such a row teaches nothing either."""
    return F.coalesce(remainder("doc_id", n) == held, F.lit(False)).alias("held_out")


def language_dictionaries(docs: DataFrame) -> dict[str, bytes]:
    """Learned from rows outside the held-out quarter only."""
    return language_id.train(docs.where(remainder("doc_id", 4) != 2))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = document_table(spark, sf_dir)
    found = language_id.identify(docs, language_dictionaries(docs))
    return found.select("doc_id", _held_out(4, 2), "lang_pred", "score", "margin", "rejected")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(document_table(spark, sf_dir))


def _scored(spark: SparkSession, sf_dir: str, label: str, n: int, held: int, settings, threshold: float) -> DataFrame:
    docs = document_table(spark, sf_dir)
    labels = document_table(spark, sf_dir, "labels").where(remainder("doc_id", n) != held).select("doc_id", label)
    model = subword_softmax.train(docs, labels, label, settings)
    found = subword_softmax.score(docs, model, threshold)
    return found.select("doc_id", _held_out(n, held), "score", "predicted")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, "quality", 4, 2, QUALITY, 0.7)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read(token_files.write(document_table(spark, sf_dir), VOCABULARY))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find(document_table(spark, sf_dir))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(document_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.neighbours(document_table(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, "toxic", 5, 0, TOXIC, 0.5)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(document_table(spark, sf_dir), VOCABULARY)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(document_table(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(document_table(spark, sf_dir, "conversations"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(document_table(spark, sf_dir))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(document_table(spark, sf_dir)).drop("base_places")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_language_id, op2_mixing, op3_quality, op4_token_files, op5_personal_data, op6_nearest, op7_fingerprints, op8_toxicity, op9_bpe, op10_simhash, op11_prefix_trie, op12_merkle_manifest, op13_license_scan)
}
ORACLES: dict[str, str] = {"op11_prefix_trie": oracle.PREFIX_TRIE, "op12_merkle_manifest": oracle.MERKLE}
