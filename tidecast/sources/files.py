"""Files: model descriptions, prediction tables, sinks with a fixed column order, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A model's description is named <family>_<model>_sheet<k>_<target>_best.meta.json.
META_NAME = r"^(.+)_([^_]+)_sheet([0-9]+)_(P_Power|Q_Power)_best\.meta\.json$"
META_SCHEMA = "target string, model string, lag_policy string, features array<string>, recalc_features array<string>, best_params map<string,string>"


def model_metas(spark: SparkSession, path: str) -> DataFrame:
    """(family, model, sheet, target, lag_policy, features, file) for each description under path."""
    rows = spark.read.schema(META_SCHEMA).option("multiLine", True).json(path).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    part = lambda k: F.regexp_extract("file", META_NAME, k)
    named = rows.withColumns({"family": part(1), "named_model": part(2), "sheet": part(3).try_cast("int"), "named_target": part(4)})
    return named.select("family", F.coalesce("model", "named_model").alias("model"), "sheet", F.coalesce("target", "named_target").alias("target"), "lag_policy", "features", "file")


def model_pairs(metas: DataFrame) -> DataFrame:
    """(family, model, sheet, usable, reason): pairs need both targets, once each, with one lag policy."""
    got = metas.where("sheet is not null").groupBy("family", "model", "sheet").agg(F.array_sort(F.collect_set("target")).alias("targets"), F.count("*").alias("n"), F.count_distinct("lag_policy").alias("policies"))
    reason = F.when(F.size("targets") < 2, "a target is missing").when(F.col("n") > 2, "a target is there twice").when(F.col("policies") > 1, "lag policies differ")
    return got.select("family", "model", "sheet", reason.isNull().alias("usable"), reason.alias("reason"))


def write_table(df: DataFrame, path: str, columns: list[str], kind: str = "parquet", by: list[str] | None = None, replace: bool = False) -> None:
    """Writes columns in their order; refuses a path that exists unless it may be replaced."""
    writer = df.select(*columns).write.mode("overwrite" if replace else "errorifexists")
    if by:
        writer = writer.partitionBy(*by)
    if kind == "csv":
        writer = writer.option("header", True)
    writer.format(kind).save(path)


def normalise_names(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """df with columns renamed by patterns that match their lower-case names; unnamed columns go."""
    import re

    keep = []
    for name in df.columns:
        if name.lower().startswith("unnamed"):
            continue
        new = next((to for pattern, to in wanted.items() if re.search(pattern, name.lower())), name)
        keep.append(F.col(f"`{name}`").alias(new))
    return df.select(*keep)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of all files under path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
