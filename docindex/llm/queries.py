"""The registered queries of the operators: each applies one to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, curve_search, exact_dedup, hard_negatives, language_id, ngram_join, quality, source_mix, substring_dedup, token_files, url_filter, whitening
from .common import table

#: Where the public vocabularies are; a parameter, never copied.
TOKENIZERS = "/opt/tokenizers"


def vocabulary(name: str) -> str:
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return f"{TOKENIZERS}/{name}"


def op1_curve_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


#: Arguments of the tool in the conversations' calls.
REPLY = {"reply": {"text": ("string", True), "turn": ("integer", True)}}


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = chat_format.as_tool_messages(table(spark, sf_dir, "conversations"))
    return chat_format.linked(messages, REPLY).withColumn("errors", F.array_join("errors", "; "))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents"))[0]


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(table(spark, sf_dir, "documents")).drop("key", "key2")


#: Host and path rules of the URL filter.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents")).drop("row_no")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    manifest = token_files.write(docs, vocabulary("word_bpe_49k.json"), token_files.fresh_folder(spark))
    return token_files.read(manifest)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, w = whitening.whiten(table(spark, sf_dir, "embeddings"))
    rows = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.element_at(F.array(*[F.lit(float(v / w.trace)) for v in w.values]).cast("array<double>"), F.col("at") + 1)
    return rows.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(w.error).alias("identity_error"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = F.col("vec_id")
    label = F.when(by % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label), by % 50 == 0)


def queries() -> dict:
    return {f.__name__: f for f in (op1_curve_search, op2_chat_format, op3_source_mix, op4_substring_dedup, op5_ngram_join, op6_url_filter, op7_byte_bpe, op8_exact_dedup, op9_language_id, op10_token_files, op11_whitening, op12_quality, op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return oracles.SQL
