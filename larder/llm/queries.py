"""The queries of the corpus operators: name -> (spark, sf_dir) -> DataFrame, and their SQL where there is one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larder.llm import decontamination, html_text, jaccard_join, media_ts, merkle_manifest, mixing, quality_lm, ranked_search, resharding, secret_ledger, suffix_dedup, token_counts, toxicity
from larder.llm.common import shared_dir, table


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shingles and the component of its links."""
    return jaccard_join.link_components(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark windows in it."""
    return decontamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op4_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shard and slot, as read back from the shards."""
    return resharding.sharded(table(spark, sf_dir, "documents"))


def op5_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document, found through a new ledger."""
    return secret_ledger.secrets_by_ledger(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/larder-ledger/{uuid.uuid4()}")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the grammar, fitted to the labels."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op7_media_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a transport stream and read back, with digests of both."""
    return media_ts.media_digests(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = "/opt/tokenizers/byte_bpe_50k.json") -> DataFrame:
    """Words and tokens of every document by a public byte-level vocabulary."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its sampling probability and whether it is sampled."""
    mixed = mixing.mix(mixing.lean(table(spark, sf_dir, "documents")))
    return mixed.selectExpr("doc_id", "coalesce(source, '') AS source", "coalesce(lang, '') AS lang", "topic", "n_tokens", "probability", "sampled")


def op9_mixing_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op9_mixing."""
    mixed = mixing.mix(mixing.lean(table(spark, sf_dir, "documents")))
    return mixed.selectExpr("doc_id", "coalesce(source, '') AS source", "coalesce(lang, '') AS lang", "topic", "n_tokens", "probability", "sampled")


def op9_mixing_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and sampled shares of each source, language and topic."""
    return mixing.achieved(mixing.mix(mixing.lean(table(spark, sf_dir, "documents"))))


def op10_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its perplexity, its language's quantiles and whether it is kept."""
    docs = table(spark, sf_dir, "documents")
    return quality_lm.judged(docs, quality_lm.trusted_ids(table(spark, sf_dir, "labels")))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A leaf, a proof and a verdict for every document."""
    return merkle_manifest.proofs(table(spark, sf_dir, "documents"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that an earlier one has: what goes, and a digest of what stays."""
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_html_text, op2_jaccard_join, op3_decontamination, op4_resharding, op5_secret_ledger, op6_toxicity, op7_media_ts, op8_token_counts, op9_mixing, op10_quality_lm, op9_mixing_to_targets, op9_mixing_shares, op11_merkle_manifest, op12_suffix_dedup, op13_ranked_search)}
SQL: dict[str, str] = {"op3_decontamination": decontamination.SQL, "op9_mixing": mixing.SQL, "op9_mixing_to_targets": mixing.SQL, "op11_merkle_manifest": merkle_manifest.SQL, "op12_suffix_dedup": suffix_dedup.SQL, "op13_ranked_search": ranked_search.SQL}
