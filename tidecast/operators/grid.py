"""Hourly grids: completeness, gaps, duplicates, daily origins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keep_last(df: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """One row for each key: the one that arrived last."""
    last = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(arrival)))
    return df.withColumn("_last", last).where("_last = 1").drop("_last")


def audit_grid(df: DataFrame, ts: str = "ts", values: list[str] | None = None) -> DataFrame:
    """One row: rows, distinct hours, hours that the span has, missing and repeated hours, off-grid stamps, bad values."""
    bad = F.lit(0)
    for v in values or []:
        bad = bad + F.when(F.col(v).isNull() | F.isnan(v), 1).otherwise(0)
    on_grid = F.date_trunc("hour", F.col(ts).cast("timestamp")).cast("timestamp_ntz") == F.col(ts)
    got = df.agg(F.count("*").alias("n_rows"), F.count_distinct(ts).alias("n_hours"), F.min(ts).alias("a"), F.max(ts).alias("b"), F.sum((~on_grid).cast("long")).alias("off_grid"), F.sum(bad).cast("long").alias("bad_values"))
    span = F.expr("cast(timestampdiff(hour, a, b) as bigint) + 1")
    return got.select("n_rows", "n_hours", span.alias("span_hours"), (span - F.col("n_hours")).alias("missing"), (F.col("n_rows") - F.col("n_hours")).alias("repeated"), "off_grid", "bad_values")


def missing_hours(df: DataFrame, grid: DataFrame, ts: str = "ts") -> DataFrame:
    """Hours of the grid that df lacks."""
    return grid.join(df.select(ts).distinct(), ts, "left_anti")


def complete_days(df: DataFrame, horizon: int = 24, keys: tuple[str, ...] = (), ts: str = "ts") -> DataFrame:
    """(keys, date) of the days whose horizon hours are all there."""
    days = df.groupBy(*keys, F.to_date(ts).alias("date")).agg(F.count_distinct(ts).alias("n"))
    return days.where(F.col("n") == horizon).drop("n")


def common_stamps(facts: DataFrame, model: str = "model_id", keys: tuple[str, ...] = ("target", "ts")) -> DataFrame:
    """The keys that every model has: counted, then kept by a semi join, not by models joined one by one."""
    models = facts.agg(F.count_distinct(model).alias("m"))
    counted = facts.groupBy(*keys).agg(F.count_distinct(model).alias("n"))
    return counted.join(F.broadcast(models), counted["n"] == models["m"], "left_semi").drop("n")
