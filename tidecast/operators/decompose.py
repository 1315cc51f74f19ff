"""Trend, daily and weekly parts by moving averages, outliers against them, and filling of gaps; windows alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_trend(obs: DataFrame, width: int = 24) -> DataFrame:
    frame = W.partitionBy("target").orderBy("ts").rowsBetween(-(width // 2), (width + 1) // 2 - 1)
    return obs.withColumn("trend", F.avg("y").over(frame))


def decompose(obs: DataFrame) -> DataFrame:
    """trend, daily, weekly and resid; the parts are means by hour, and by weekday and hour, of what is left."""
    out = with_trend(obs)
    out = out.withColumn("daily", F.avg(F.col("y") - F.col("trend")).over(W.partitionBy("target", F.hour("ts"))))
    out = out.withColumn("weekly", F.avg(F.col("y") - F.col("trend") - F.col("daily")).over(W.partitionBy("target", F.weekday("ts"), F.hour("ts"))))
    return out.withColumn("resid", F.col("y") - F.col("trend") - F.col("daily") - F.col("weekly"))


def null_outliers(obs: DataFrame, most: float = 550, least: float = 100) -> DataFrame:
    """y becomes null where it lies more than `most` from the trend, below `least`, or under half of the trend."""
    y, trend = F.col("y"), F.col("trend")
    odd = (F.abs(y - trend) > most) | (y < least) | (F.coalesce(F.try_divide(trend - y, y), F.lit(0.0)) > 1)
    return with_trend(obs).withColumn("y", F.when(~odd, y)).drop("trend")


def fill_gaps(obs: DataFrame) -> DataFrame:
    """filled: missing and zero values become the mean of the same weekday and hour; was_missing tells which."""
    rows = obs.withColumn("y", F.when(F.col("y") != 0, F.col("y")))
    mean = F.avg("y").over(W.partitionBy("target", F.weekday("ts"), F.hour("ts")))
    return rows.withColumn("filled", F.coalesce("y", mean)).withColumn("was_missing", F.col("y").isNull().cast("int"))
