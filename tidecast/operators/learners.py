"""Models that are fitted: least squares by aggregates per origin, gradient boosting and bootstraps in grouped Arrow."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.operators.features import lag_features


def linear_walk_forward(obs: DataFrame, origins: DataFrame, lag: int = 24) -> DataFrame:
    """(origin, target, slope, intercept, n): y on its lag, refitted for each origin on all rows before it.

    The fit needs five running sums only: rows are summed per day, days are accumulated, and each origin reads one row, so
    that no origin meets its whole history.
    """
    from pyspark.sql import Window as W

    rows = lag_features(obs, [lag]).where(f"lag_{lag} is not null").withColumn("x", F.col(f"lag_{lag}"))
    sums = {"n": F.count("*"), "sx": F.sum("x"), "sy": F.sum("y"), "sxx": F.sum(F.col("x") * F.col("x")), "sxy": F.sum(F.col("x") * F.col("y"))}
    daily = rows.groupBy("target", F.to_date("ts").alias("date")).agg(*[v.alias(k) for k, v in sums.items()])
    past = W.partitionBy("target").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    total = daily.select("target", F.date_add("date", 1).alias("origin"), *[F.sum(k).over(past).alias(k) for k in sums])
    got = total.join(origins, "origin")
    slope = F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))
    return got.withColumn("slope", slope).select("origin", "target", "slope", ((F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n")).alias("intercept"), "n")


def boosted_forecast(frame: DataFrame, features: list[str], split: str, label: str = "y", rounds: int = 20, depth: int = 3, seed: int = 42) -> DataFrame:
    """frame from `split` on with y_pred, from gradient-boosted trees that are fitted on the rows before it."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip").transform(frame)
    train = rows.where(F.col("ts") < F.lit(split).cast("timestamp_ntz"))
    model = GBTRegressor(featuresCol="_x", labelCol=label, predictionCol="y_pred", maxIter=rounds, maxDepth=depth, seed=seed).fit(train)
    return model.transform(rows.where(F.col("ts") >= F.lit(split).cast("timestamp_ntz"))).drop("_x")


def block_bootstrap_bounds(errors: DataFrame, keys: list[str], block: int = 24, draws: int = 200, coverage: float = 0.8, seed: int = 42) -> DataFrame:
    """(keys, lower, upper): equal-tailed bounds of moving-block bootstrap means of each group's errors, in order of ts.

    Groups are series of one model and target; draws are seeded by the group's key and do not depend on partitions.
    """
    import zlib

    def bounds(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        series = frame.sort_values("ts")["error"].to_numpy()
        rng = np.random.default_rng([seed, zlib.crc32("|".join(map(str, key)).encode())])
        width = min(block, len(series))
        starts = rng.integers(0, len(series) - width + 1, (draws, -(-len(series) // width)))
        sample = series[(starts[..., None] + np.arange(width)).reshape(draws, -1)[:, : len(series)]]
        low, high = np.quantile(sample.mean(axis=1), [(1 - coverage) / 2, (1 + coverage) / 2])
        return pd.DataFrame([[*key, low, high]], columns=[*keys, "lower", "upper"])

    schema = ", ".join(f"{k} string" for k in keys) + ", lower double, upper double"
    return errors.select(*keys, "ts", "error").groupBy(*keys).applyInPandas(bounds, schema)


def two_lag_fits(obs: DataFrame, origins: DataFrame, lags: tuple[int, int] = (1, 24)) -> DataFrame:
    """(origin, gap, target, n, a, b, c): y = a + b y[t - lags[0]] + c y[t - lags[1]], by least squares over all rows of the
    days before origin - gap, for each row (origin, gap) of origins.

    Sums of the centred values per day are accumulated, so that an origin reads one row of each target; values are shifted by
    the target's mean first, which the slopes do not see and which keeps the sums' digits.
    """
    from pyspark.sql import Window as W

    first, second = lags
    rows = lag_features(obs, [first, second]).where(f"lag_{second} is not null")
    mean = F.broadcast(obs.groupBy("target").agg(F.avg("y").alias("m")))
    rows = rows.join(mean, "target").select("target", "m", F.to_date("ts").alias("date"), (F.col("y") - F.col("m")).alias("y"), (F.col(f"lag_{first}") - F.col("m")).alias("x"), (F.col(f"lag_{second}") - F.col("m")).alias("z"))
    pairs = {"xx": ("x", "x"), "zz": ("z", "z"), "xz": ("x", "z"), "xy": ("x", "y"), "zy": ("z", "y")}
    sums = {"n": F.count("*"), "sx": F.sum("x"), "sz": F.sum("z"), "sy": F.sum("y"), **{k: F.sum(F.col(p) * F.col(q)) for k, (p, q) in pairs.items()}}
    daily = rows.groupBy("target", "m", "date").agg(*[v.alias(k) for k, v in sums.items()])
    past = W.partitionBy("target").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    total = daily.select("target", "m", F.date_add("date", 1).alias("until"), *[F.sum(k).over(past).alias(k) for k in sums])
    got = total.join(F.broadcast(origins.withColumn("until", F.expr("date_sub(origin, gap)"))), "until")
    n = F.col("n")
    centred = {k: F.col(k) / n - F.col(f"s{p}") / n * F.col(f"s{q}") / n for k, (p, q) in pairs.items()}
    got = got.withColumns({f"c{k}": v for k, v in centred.items()})
    room = F.col("cxx") * F.col("czz") - F.col("cxz") * F.col("cxz")
    b = F.try_divide(F.col("cxy") * F.col("czz") - F.col("czy") * F.col("cxz"), room)
    c = F.try_divide(F.col("czy") * F.col("cxx") - F.col("cxy") * F.col("cxz"), room)
    got = got.withColumns({"b": b, "c": c})
    a = (F.col("sy") - F.col("b") * F.col("sx") - F.col("c") * F.col("sz")) / n + F.col("m") * (1 - F.col("b") - F.col("c"))
    return got.select("origin", "gap", "target", "n", a.alias("a"), "b", "c")


def two_lag_recursion(obs: DataFrame, fits: DataFrame, steps: int, longest: int = 24) -> DataFrame:
    """(origin, gap, target, horizon, y_pred): each fit's own recursion from the last values before its origin.

    Each observation is sent to the one origin whose look-back holds it; a forecast is one fold over an array.
    """
    days = fits.select("origin").distinct()
    sent = obs.withColumn("origin", F.date_add(F.to_date("ts"), 1)).join(F.broadcast(days), "origin")
    history = sent.groupBy("origin", "target").agg(F.array_sort(F.collect_list(F.struct("ts", "y"))).alias("h")).select("origin", "target", F.slice("h.y", -longest, longest).alias("s"))
    met = fits.join(history, ["origin", "target"])

    def step(s: F.Column, _: F.Column) -> F.Column:
        return F.concat(s, F.array(F.col("a") + F.col("b") * F.element_at(s, -1) + F.col("c") * F.element_at(s, -longest)))

    done = met.withColumn("s", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.col("s"), step))
    return done.select("origin", "gap", "target", F.posexplode(F.slice("s", -steps, steps)).alias("k", "y_pred")).withColumn("horizon", F.col("k") + 1).drop("k")


def direct_forecast(obs: DataFrame, cutoff: str, lag: int = 24) -> DataFrame:
    """(target, ts, horizon, y_pred) from the cutoff on: one line for each target and hour of the day, y on its lag, fitted on the rows
    before the cutoff; no forecast feeds another."""
    rows = lag_features(obs, [lag]).where(f"lag_{lag} is not null").withColumns({"x": F.col(f"lag_{lag}"), "horizon": F.hour("ts") + 1})
    at = F.lit(cutoff).cast("timestamp_ntz")
    fits = rows.where(F.col("ts") < at).groupBy("target", "horizon").agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"))
    return rows.where(F.col("ts") >= at).join(F.broadcast(fits), ["target", "horizon"]).select("target", "ts", "horizon", (F.col("a") + F.col("b") * F.col("x")).alias("y_pred"))


def fold_sums(rows: DataFrame, folds: DataFrame, columns: list[str], days: int) -> DataFrame:
    """(fold, part, n, <means of columns>): the rows before each fold's cut as train, those of the days after it as test.

    Rows are summed per day first, and days accumulate, so that a fold reads a few rows and not its whole history; cuts are midnights.
    """
    from pyspark.sql import Window as W

    daily = rows.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in columns])
    names = ["n", *columns]
    past = W.orderBy("day").rowsBetween(W.unboundedPreceding, 0)  # a row for each day
    total = daily.select("day", *[F.sum(c).over(past).alias(c) for c in names])
    cut = F.to_date("cut")
    train = folds.select("fold", F.lit("train").alias("part"), F.date_sub(cut, 1).alias("day")).join(total, "day")
    spans = folds.select("fold", F.lit("test").alias("part"), F.explode(F.sequence(cut, F.date_add(cut, days - 1))).alias("day"))
    each = train.select("fold", "part", *names).unionByName(spans.join(daily, "day").select("fold", "part", *names))
    got = each.groupBy("fold", "part").agg(*[F.sum(c).alias(c) for c in names])
    return got.select("fold", "part", "n", *[(F.col(c) / F.col("n")).alias(c) for c in columns])
