"""The corpus pipeline: quality rules, exact and near deduplication, mixing, packing.

Each stage is a function of (spark, docs, sf_dir). All but the last return rows with the columns of ``documents``; the last
returns a row per packed piece. What a stage returns is written and read again as the next one's documents.

Of all stages: texts of any length are read whole; an empty table gives an empty result; further columns, whatever their names, come
through as they are (packing returns its own); a null doc_id or source is allowed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from claimloom.llm import exact_dedup, mixing, near_dedup, packing, quality
from claimloom.llm.shared import materialize

#: Words that encoders remember: fewer than by default, as workers have served other stages before.
WORDS = 150_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of the threshold table; null and empty texts have no words and go, repeated rows are judged alike."""
    return quality.keep(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that of the smallest doc_id, nulls last; null counts as empty, of repeated rows one stays."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: five-word shingles, similarity of at least 0.8.

    That of the smallest doc_id stays. Texts without words and null doc_ids are linked with nothing and stay; rows that share a
    doc_id are one document.
    """
    return near_dedup.keep_one(docs, width=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources up to one and a half times on average.

    A null source is a source of its own; texts without tokens are used once a pass; repeated rows are mixed one by one.
    """
    return mixing.mix_sources(docs, vocabulary=public_tokenizers.path("word_bpe_49k.json"), words=WORDS)[0].select(*docs.columns)


def token_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens; a null text is a piece of the end id only, repeated documents are packed once each."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, words=WORDS)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("source_mix", source_mix),
    ("packing", token_packing),
]

#: The near-duplicate, mixing and packing stages are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
