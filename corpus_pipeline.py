"""Corpus pipeline: five stages, each over all rows that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
``run`` writes each stage's rows to the shared folder and reads them again for the next. Every stage takes nulls in any
column, repeated rows, empty tables (which give empty results) and further columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldspark.llm import mixing, ngram_join, packing, pii, quality
from fieldspark.llm.common import table, vocabulary, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from ``labels`` outside the held-out fold. A null text is
    scored as an empty one; without labels of both classes the share of good labels decides for all."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group that links of the n-gram join connect. Null and empty
    texts and null ids link with nothing and stay; repeated rows of a kept id stay too."""
    return ngram_join.one_of_each_group(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; null texts stay null, and no row goes."""
    return pii.redact_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the amounts that the source targets ask for, in the schedule's order: some again, some cut or left out.
    A null source is one like others; texts without words are left out, as the mix counts words."""
    return mixing.mixed_corpus(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids, each with its sequence and place; a null text is its end id alone."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality", keep_good), ("near_copies", drop_near_copies), ("personal_data", redact), ("mix", mix), ("pack", pack)]

#: Trained models, tokenizers and hash orders are no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
