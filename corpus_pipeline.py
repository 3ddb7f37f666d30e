"""A corpus pipeline of five operators, each stage written as Parquet and read again.

Toxic documents go, then those that fail the quality rules, then all but one of
each near-duplicate component; sources are mixed to target weights (a document
may be drawn more than once), and the rest is encoded to pieces.

Every stage but the last returns the columns of documents, of whatever further
columns and names. Nulls: a null or empty text is scored like any other by the
first stage and fails the quality rules; null ids stay apart by their texts;
null sources are one source. Texts of any length are taken whole. Repeated
rows are copies, of which one stays, the one whose other columns have the least
hash; ties of ids go to the least id. An empty table gives an empty result.

No stage can be told in SQL as a whole (the first learns a model), so ORACLE_SQL
is None; tests hold every stage against a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sourcelode.llm import mixing, quality_rules, sentencepiece_codec, simhash, toxicity
from sourcelode.llm.common import materialise, table

ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", dedup_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
