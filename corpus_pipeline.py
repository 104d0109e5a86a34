"""A training-corpus pipeline: five stages over the documents table, each of one corpus operator.

Toxic documents go; of each group of near-duplicate documents the one with the least id stays; documents that
hold benchmark passages go; the rest is sampled to target weights of source, language and topic; what is left
is dealt to shards of near-equal bytes, written, and returned. Every stage takes all rows its predecessor kept.

Nulls and empty texts pass every stage but the sampling, where they weigh nothing and stay; a null doc_id is no
duplicate; rows that repeat count as duplicates of each other only if another id is smaller, so they stay together;
empty tables give empty results; extra columns are carried through; very long texts are read whole by one task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from larder.llm import decontamination, jaccard_join, mixing, resharding, toxicity
from larder.llm.common import shared_dir, small_batches, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the grammar, fitted to the labels, scores as toxic."""
    return toxicity.keep_civil(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that share 75 % of their word shingles, the one with the least id."""
    return jaccard_join.keep_first(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold a window of a benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of docs whose tokens by source, language and topic meet the tempered targets."""
    return mixing.sample(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs as read back from their new shards, with old_shard, size, slot and shard."""
    return resharding.written(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: No SQL: learned arcs and components of similarity links; tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4()}"
    with small_batches(spark):
        for name, stage in STAGES:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    return docs
