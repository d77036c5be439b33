"""Corpus pipeline: quality rules, language, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is
written as Parquet to the shared folder and read again as the next stage's docs. All but the
last return the columns of ``documents``.

Defined results: a null text counts as empty and goes with the quality rules; of equal rows (and
of near duplicates) one stays, the one with the smallest id, of several with that id the one with
the smallest text; rows without an id are judged like others, and come after those with one; an
empty table gives no rows; other columns of docs are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import langid, packing, quality, secrets, simhash_dedup
from larder.llm.common import stored, table


#: Encoded words that a worker keeps while packing: fewer than alone, since the stages share the executors' memory.
KEPT_WORDS = 150_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep(docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that most of their letters agree on go; a null lang is filled."""
    return langid.keep(docs, langid.train(langid.learned_rows(docs)))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays."""
    return simhash_dedup.one_of_each(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; n_chars follows."""
    return secrets.redact(docs, secrets.train(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences, with their ids."""
    return packing.pack(docs, packing.tokenizer_file(), kept_words=KEPT_WORDS)


STAGES = [
    ("quality_rules", quality_stage),
    ("language_id", language_stage),
    ("simhash_dedup", dedup_stage),
    ("secret_scan", secrets_stage),
    ("packing", packing_stage),
]

#: Trained models, XXH64 votes and tokenizers have no form in SQL; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(spark, stage(spark, docs, sf_dir), name)
    return docs
