"""Checks that refuse: what would let the future into a forecast, and tables that are not what they say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.operators.planner import catalogue


def leaks(artifacts: DataFrame, columns: DataFrame, horizon: int, targets: tuple[str, ...] = ("P_Power", "Q_Power")) -> DataFrame:
    """(model_id, target, feature, fault): every feature that breaks a rule, with the first rule that it breaks.

    artifacts: (model_id, target, lag_policy, features, recalc_features); columns: (feature), what the data offer.  A feature
    must be a column, may not be a target itself, and is dynamic (a lag or rolling statistic of a target) only where the policy
    allows its owner; rolling statistics, and lags shorter than the horizon, must be recalculated; what is recalculated must be
    a dynamic feature of the model.
    """
    base = artifacts.select("model_id", "target", "lag_policy", "features", F.coalesce("recalc_features", F.array().cast("array<string>")).alias("recalc"))
    used = base.select("model_id", "target", "lag_policy", F.explode(F.array_union("features", "recalc")).alias("feature"), "features", "recalc")
    used = used.withColumns({"listed": F.array_contains("features", F.col("feature")), "again": F.array_contains("recalc", F.col("feature"))}).drop("features", "recalc")
    parsed = catalogue(used.select("feature").distinct(), list(targets))
    there = columns.select("feature").distinct().withColumn("there", F.lit(True))
    met = used.join(parsed, "feature").join(there, "feature", "left")
    dynamic = F.col("owner").isNotNull() & (F.col("kind") != "static")
    fault = (
        F.when(F.col("again") & ~F.col("listed"), "recalculated but not a feature")
        .when(F.col("feature").isin(*targets), "a raw target")
        .when(F.col("there").isNull(), "not a column")
        .when(F.col("again") & ~dynamic, "recalculated but not dynamic")
        .when(dynamic & (F.col("lag_policy") == "drop"), "dynamic under the policy drop")
        .when(dynamic & (F.col("lag_policy") == "own") & (F.col("owner") != F.col("target")), "another target under the policy own")
        .when(dynamic & (F.col("kind") != "lag") & ~F.col("again"), "a rolling statistic that is not recalculated")
        .when(dynamic & (F.col("hours") < horizon) & ~F.col("again"), "a short lag that is not recalculated")
    )
    return met.withColumn("fault", fault).where("fault is not null").select("model_id", "target", "feature", "fault")


def origin_counts(daily: DataFrame, expected: int, key: str = "model_id", origin: str = "date") -> DataFrame:
    """(key, origins, complete): does each system have the expected number of distinct origins?"""
    return daily.groupBy(key).agg(F.count_distinct(origin).alias("origins")).withColumn("complete", F.col("origins") == expected)


def one_vector(anchors: DataFrame, key: str, parameters: list[str]) -> DataFrame:
    """(key, targets, vectors, consistent): do all targets of an anchor share one parameter vector?"""
    got = anchors.groupBy(key).agg(F.count_distinct("target").alias("targets"), F.count_distinct(F.struct(*parameters)).alias("vectors"))
    return got.withColumn("consistent", (F.col("targets") == 2) & (F.col("vectors") == 1))


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left joined to right, where each key stands once on either side and on both; otherwise the query fails."""
    counts = left.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(right.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    checked = counts.groupBy(*keys).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    wrong: Column = (F.col("_l") != 1) | (F.col("_r") != 1)
    checked = checked.withColumn("_ok", F.when(wrong, F.raise_error(F.lit("keys do not match one to one")).cast("boolean")).otherwise(True)).where("_ok").select(*keys)
    return checked.join(left, keys).join(right, keys)
