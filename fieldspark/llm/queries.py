"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldspark.llm import conversations, cover_tree, gif, mixing, ngram_join, oracles, packing, pii, quality, secret_scan, sharding, spelling, warc, wavelet
from fieldspark.llm.common import table, vocabulary

Query = Callable[[SparkSession, str], DataFrame]


def op1_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op3_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.gif_documents(table(spark, sf_dir, "documents"))


def op5_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.document_components(table(spark, sf_dir, "documents"))


def op7_cover_tree_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op9_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op11_pivotal_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_assignment_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_conversations(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Query]:
    every = (
        op1_hash_tree_sharding, op2_source_mixing, op3_wavelet_tokens, op4_gif_media, op5_boosted_pii,
        op6_ngram_jaccard_join, op7_cover_tree_duplicates, op8_warc_archives,
        op9_quality_discriminant, op10_sum_of_squares_packing, op11_pivotal_spelling, op12_assignment_secrets,
        op13_conversation_repair,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """SQL of three queries; the others rest on hash orders, codecs, models, lexers or reachability."""
    return dict(oracles.SQL)
