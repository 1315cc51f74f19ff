"""A corpus pipeline of five operators: each stage is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm import decontaminate, jaccard_join, packing, shared, substring_dedup, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near duplicates connect (five-word shingles, similarity of 0.8 or more), the one of smallest id.

    Of rows that repeat a doc_id one stays, the first by the hash of its columns; rows without a doc_id stay."""
    groups = jaccard_join.jaccard_components(docs, words=5, percent=80)
    groups = shared.durable(groups.select("doc_id", "component_id"))
    gone = shared.durable(groups.where("doc_id <> component_id").select("doc_id").distinct())
    kept = docs.join(shared.few(gone), "doc_id", "left_anti").select(docs.columns)
    twice = groups.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.isEmpty():
        return kept
    twice = shared.durable(twice)
    one = kept.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row"))
    return kept.join(twice, "doc_id", "left_anti").select(docs.columns).unionByName(one.select("row.*"))


def strip_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that a run of 50 words repeats from an earlier one."""
    out = substring_dedup.strip_repeats(docs, window=50)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    found, _ = decontaminate.occurrences(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
    found = shared.durable(found.select("doc_id").distinct())
    return docs.join(shared.few(found), "doc_id", "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, packed into sequences of 1024 tokens."""
    return packing.pack_documents(docs, length=1024)


_before: list[DataFrame] = []


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """f, which first removes the tables that the stage before it left: its rows are written by now."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _before:
            shared.discard(_before.pop())
        shared.small_batches(spark)
        held = {t.written for t in shared.tables_left()}
        out = f(spark, docs, sf_dir)
        _before.extend(t for t in shared.tables_left() if t.written not in held)
        return out

    run_stage.__name__, run_stage.__doc__ = f.__name__, f.__doc__
    return run_stage


STAGES = [
    ("toxicity", _stage(drop_toxic)),
    ("ngram_jaccard_join", _stage(one_of_each_group)),
    ("substring_dedup", _stage(strip_repeats)),
    ("benchmark_decontamination", _stage(drop_contaminated)),
    ("best_fit_packing", _stage(pack)),
]

#: SQL can train neither the classifier nor run the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared.folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
