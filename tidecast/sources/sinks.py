"""Writing results: run folders, small files that appear whole, exports that are read back, fitted models."""

from __future__ import annotations

import json

from pyspark.ml.util import MLReadable, MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def run_directory(spark: SparkSession, root: str, name: str) -> str:
    """root/name, or root/name_2, _3, ... if it is there already; made here, so that no two runs share one."""
    for k in range(1, 10_000):
        path = f"{root}/{name}" if k == 1 else f"{root}/{name}_{k}"
        files, at = _path(spark, path)
        if not files.exists(at):
            files.mkdirs(at)
            return path
    raise ValueError(f"{root}/{name} and all its numbered names are taken")


def write_whole(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file beside its place and renames it: readers see the old content, none for a moment, or the new one, never a part."""
    files, at = _path(spark, path)
    _, beside = _path(spark, f"{path}.part")
    out = files.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    if files.exists(at):
        files.delete(at, False)
    if not files.rename(beside, at):
        raise OSError(f"could not rename to {path}")


def write_json(spark: SparkSession, path: str, content: object) -> None:
    write_whole(spark, path, json.dumps(content, indent=1, sort_keys=True))


def write_checked(df: DataFrame, path: str, keys: list[str]) -> int:
    """Writes a table and reads it back: the same number of rows, each key once; returns the number."""
    df.write.parquet(path)
    again = df.sparkSession.read.parquet(path)
    n, distinct = again.agg(F.count("*"), F.count_distinct(*keys)).first()
    if n != df.count() or n != distinct:
        raise ValueError(f"{path}: {n} rows, {distinct} keys")
    return n


def export_trials(trials: DataFrame, folds: DataFrame, folder: str, run: str = "run_id") -> None:
    """folder/trials, folder/trials_long (a row for each fold of each trial) and folder/cost (totals of each run)."""
    trials.write.partitionBy(run).parquet(f"{folder}/trials")
    folds.join(trials.select(run, "trial", "state"), [run, "trial"]).write.partitionBy(run).parquet(f"{folder}/trials_long")
    costs = trials.groupBy(run).agg(F.count("*").alias("terminal"), F.count_if(F.col("state") == "COMPLETE").alias("complete"), F.sum("fits").alias("fits"), F.sum("seconds").alias("seconds"))
    costs.write.json(f"{folder}/cost")


def save_model(model: MLWritable, path: str, features: list[str], target: str) -> None:
    """A fitted model with the names that it needs, beside it."""
    model.write().overwrite().save(path)
    write_json(SparkSession.active(), f"{path}.meta.json", {"features": features, "target": target, "class": type(model).__name__})


def load_model(spark: SparkSession, path: str, kind: type[MLReadable]) -> tuple[object, dict]:
    meta = json.loads(spark.read.text(f"{path}.meta.json", wholetext=True).first()[0])
    if meta["class"] != kind.__name__:
        raise ValueError(f"{path} holds a {meta['class']}, not a {kind.__name__}")
    return kind.load(path), meta
