"""Contracts as queries: each returns the rows, or the counts, that break a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def finite(*columns: str) -> Column:
    """All columns hold a finite number."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return out


def recursion_gaps(obs: DataFrame, history_end: str, test_end: str) -> DataFrame:
    """(target, expected, present, missing, beyond): is every hour in (history_end, test_end] there, and none after it?"""
    a, b = F.lit(history_end).cast("timestamp_ntz"), F.lit(test_end).cast("timestamp_ntz")
    inside = (F.col("ts") > a) & (F.col("ts") <= b)
    got = obs.groupBy("target").agg(F.count_distinct(F.when(inside, F.col("ts"))).alias("present"), F.count_if(F.col("ts") > b).alias("beyond"))
    return got.select("target", F.expr(f"timestampdiff(hour, timestamp_ntz '{history_end}', timestamp_ntz '{test_end}')").cast("long").alias("expected"), "present", "beyond").withColumn("missing", F.col("expected") - F.col("present"))


def split_faults(splits: DataFrame, last: str) -> DataFrame:
    """splits with the first rule that each breaks, or `ok`: order of bounds, leakage, a whole test day, bounds of the data."""
    fault = (
        F.when(F.col("train_start") >= F.col("train_end"), "empty training")
        .when(F.col("train_end") >= F.col("test_start"), "training reaches the test")
        .when(F.expr("timestampdiff(hour, test_start, test_end)") != 23, "test is not a day")
        .when(F.col("test_end") > F.lit(last).cast("timestamp_ntz"), "test beyond the data")
        .otherwise("ok")
    )
    return splits.withColumn("fault", fault)


def history_end(splits: DataFrame, policy: str) -> DataFrame:
    """The last hour that a forecast may use: an hour before the test, or the end of training."""
    end = F.expr("test_start - interval 1 hour") if policy == "before_test" else F.col("train_end")
    return splits.withColumn("history_end", end)


def history_holes(obs: DataFrame, origins: DataFrame, hours: int) -> DataFrame:
    """(origin, target, found): how many finite values stand in the look-back of each origin; each value is sent to the
    days that look back on it, so that origins and values meet on equal days."""
    days = -(-hours // 24)
    sent = obs.where(finite("y")).select("target", "ts", F.explode(F.sequence(F.lit(0), F.lit(days))).alias("k")).withColumn("origin", F.date_add(F.to_date("ts"), F.col("k")))
    met = sent.join(origins, "origin").where(f"ts < cast(origin as timestamp_ntz) and ts >= cast(origin as timestamp_ntz) - interval {hours} hours")
    return met.groupBy("origin", "target").agg(F.count("*").alias("found"))


def key_differences(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side): keys that only one of the two has."""
    left = a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "left_anti").withColumn("side", F.lit("left"))
    right = b.select(*keys).distinct().join(a.select(*keys).distinct(), keys, "left_anti").withColumn("side", F.lit("right"))
    return left.unionByName(right)


def trajectory_faults(facts: DataFrame, horizon: int = 24) -> DataFrame:
    """(model_id, target, origins, faulty): trajectories without each horizon once, or whose stamps do not fit it."""
    fits = F.col("ts") == F.expr("cast(date as timestamp_ntz) + make_dt_interval(0, horizon - 1)")
    each = facts.groupBy("model_id", "target", "date").agg(F.count("*").alias("n"), F.count_distinct("horizon").alias("d"), F.min(fits.cast("int")).alias("fit"))
    bad = (F.col("n") != horizon) | (F.col("d") != horizon) | (F.col("fit") != 1)
    return each.groupBy("model_id", "target").agg(F.count("*").alias("origins"), F.count_if(bad).alias("faulty"))


def actual_differences(facts: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """(target, ts, spread): stamps at which models do not see the same actual value."""
    return facts.groupBy("target", "ts").agg((F.max("y_true") - F.min("y_true")).alias("spread")).where(F.col("spread") > tolerance)


def cell_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) for every pair of their values, zero included: two small dimensions, no rows of df are paired."""
    counts = df.groupBy(a, b).agg(F.count("*").alias("n"))
    grid = df.select(a).distinct().join(F.broadcast(df.select(b).distinct()))
    return grid.join(counts, [a, b], "left").select(a, b, F.coalesce("n", F.lit(0)).alias("n"))


def classify_columns(df: DataFrame, columns: list[str], most: int = 24, share: float = 0.02) -> DataFrame:
    """(name, n_distinct, kind): text, or whole numbers of few values, are categorical; others numeric.  One pass."""
    n = F.count("*").alias("_n")
    got = df.agg(n, *[F.count_distinct(c).alias(c) for c in columns])
    rows = []
    whole = {"int", "bigint", "smallint", "tinyint"}
    for c in columns:
        kind = dict(df.dtypes)[c]
        few = F.col(c) <= F.greatest(F.lit(most), F.floor(F.lit(share) * F.col("_n")))
        is_category = F.lit(True) if kind in {"string", "boolean"} else (few if kind in whole else F.lit(False))
        rows.append(F.struct(F.lit(c).alias("name"), F.col(c).alias("n_distinct"), F.when(is_category, "categorical").otherwise("numeric").alias("kind")))
    return got.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def grid_audit(obs: DataFrame, history_hours: int) -> DataFrame:
    """(target, expected, present, missing, repeated, not_finite, history): what a series lacks against the hours from its first to
    its last; history counts the rows of its first history_hours."""
    ends = obs.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    rows = obs.join(F.broadcast(ends))
    early = F.col("ts") < F.col("a") + F.expr(f"interval {history_hours} hours")
    got = rows.groupBy("target").agg(F.first(F.expr("timestampdiff(hour, a, b) + 1")).cast("long").alias("expected"), F.count_distinct("ts").alias("present"), F.count("*").alias("n"), F.count_if(~F.coalesce(finite("y"), F.lit(False))).alias("not_finite"), F.count_if(early).alias("history"))
    return got.select("target", "expected", "present", (F.col("expected") - F.col("present")).alias("missing"), (F.col("n") - F.col("present")).alias("repeated"), "not_finite", "history")


def split_rules(splits: DataFrame) -> DataFrame:
    """(scheme, n, whole_days, in_order, least_gap, most_gap): how many splits of each scheme keep the rules that all share."""
    gap = F.expr("timestampdiff(hour, train_end, test_start) div 24")
    ordered = (F.col("train_start") < F.col("train_end")) & (F.col("train_end") < F.col("test_start")) & (F.col("test_start") < F.col("test_end"))
    return splits.groupBy("scheme").agg(F.count("*").alias("n"), F.count_if(F.expr("timestampdiff(hour, test_start, test_end) = 23")).alias("whole_days"), F.count_if(ordered).alias("in_order"), F.min(gap).alias("least_gap"), F.max(gap).alias("most_gap"))


def configurations(ranges: DataFrame, days: DataFrame) -> DataFrame:
    """(name, verdict) of each range of days (name, a, z): its order, whether the data (d) cover it, and whether a day is missing.

    Days are numbered and summed up once; a range reads the numbers at its ends and never its days.
    """
    numbered = days.withColumn("k", F.row_number().over(W.orderBy("d")))
    ends = days.agg(F.min("d").alias("first"), F.max("d").alias("last"))
    known = ranges.join(F.broadcast(ends))
    at = lambda c, name: numbered.select(F.col("d").alias(c), F.col("k").alias(name))
    known = known.join(at("a", "ka"), "a", "left").join(at("z", "kz"), "z", "left")
    whole = F.col("kz") - F.col("ka") == F.datediff("z", "a")
    verdict = F.when(F.col("a") > F.col("z"), "ends before it begins").when(F.col("a") < F.col("first"), "begins before the data").when(F.col("z") > F.col("last"), "ends after the data").when(~F.coalesce(whole, F.lit(False)), "a day is missing").otherwise("ok")
    return known.select("name", verdict.alias("verdict"))
