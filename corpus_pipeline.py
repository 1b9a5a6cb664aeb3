"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardscore.llm import bpe, line_quality, minhash_dedup, mixing
from wardscore.operators.settle import land


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier calls good; it learns from a bounded sample of the labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return line_quality.good_documents(docs, line_quality.train(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies: five words, similarity 0.8."""
    return minhash_dedup.without_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by probabilities raked to tempered shares of source, language and topic."""
    return mixing.sample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token ids, with their digest and that of the decoded text."""
    return bpe.digests(docs, with_ids=True)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("mix", mix), ("bpe", encode)]

# No stage can be told in SQL. The tests hold near_dedup and bpe against brute force, the others by held-out rows and margins.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = land(docs, name)
    return docs
