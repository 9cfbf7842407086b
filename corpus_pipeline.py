"""The corpus pipeline: identify languages, drop near copies, redact personal data, mix sources, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.

Defined results, for every stage: an empty table gives an empty table; repeated rows and rows that share an
id or have none are rows like any other, but that near-duplicate detection keeps one of each group; extra
columns, of whatever name, are kept by all stages but the last and clash with nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, language_id, mixing, personal_data, simhash
from quarry.llm.queries import VOCABULARY, language_dictionaries
from quarry.llm.storage import document_table, saved


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; null texts, those without letters and those with a narrow margin go. Equal sizes are a margin of 0."""
    return language_id.keep_identified(docs, language_dictionaries(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the least doc_id, null ids last. Null and empty texts are one group."""
    return simhash.keep_first(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind, overlapping spans by the first one's; null texts stay null."""
    return personal_data.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: each document as often as it is taken, null and empty texts not at all; null sources are one source."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mixture; a null text has no ids."""
    return bpe.round_trip(docs, VOCABULARY, share=0.25)  # executors that have run the stages before have less memory left


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_copies),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Dictionaries, hashes and merges of this kind have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = document_table(spark, sf_dir)
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = saved(docs, name)
    return docs
