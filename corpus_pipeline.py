"""The corpus pipeline: stages that each apply one operator to what their predecessor kept.

All stages but the last return the columns of docs, in their order, whatever else those are named; an empty table gives no rows.
Rows with a null doc_id or source are rows like others. Texts are taken whole, however long."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docindex.llm import byte_bpe, exact_dedup, language_id, ngram_join, source_mix
from docindex.llm.common import cut
from docindex.llm.queries import vocabulary


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go: those whose text is null or has no letter, and those of doubtful language. Repeated
    rows stay or go together; without labelled rows all go."""
    return language_id.identified(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the longest original, then the smallest doc_id (null last), and of repeated
    rows one. Null and blank texts are one group."""
    return exact_dedup.distinct_texts(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays: the smallest doc_id (null last), and of repeated rows one. A document
    without words is linked with nothing."""
    return ngram_join.representatives(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them, three times at most: a null source is a source of its own, last in
    order; null and blank texts have no words and are never taken; repeated rows are documents of their own."""
    return source_mix.mixed_documents(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token count and digests of every document; null is the empty text, and repeated rows are encoded each."""
    return byte_bpe.digests(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("language_id", language_stage), ("exact_dedup", dedup_stage), ("ngram_join", near_stage), ("source_mix", mix_stage), ("byte_bpe", encode_stage)]
#: The stages train a model, and encode and hash in Python: brute force stands in for SQL in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
