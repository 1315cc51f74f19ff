"""The thin queries over the ten operators: each reads its whole table and derives the columns that are asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidecast.llm import chat, decontaminate, jaccard_join, language_id, nearest, oracles, packing, shared, substring_dedup, suffix_dedup, token_store, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    shared.small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"), words=3, percent=90)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), length=100)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), length=1024)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.windows(rows.unionByName(more)), in_order=True)


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_and_read(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = _table(spark, sf_dir, "embeddings")
    return nearest.search(embeddings, embeddings.where("vec_id % 20 = 0"), k=20)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), window=50)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_jaccard_join, op2_suffix_dedup, op3_best_fit_packing, op4_chat_formatting, op5_token_ids, op6_decontamination, op7_nearest_neighbours, op8_language_id, op9_substring_dedup, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    """SQL for three of them; tokenizers, trained models, byte windows, templates and approximate search are not SQL."""
    return {"op1_jaccard_join": oracles.JACCARD, "op6_decontamination": oracles.DECONTAMINATION, "op9_substring_dedup": oracles.SUBSTRING}
