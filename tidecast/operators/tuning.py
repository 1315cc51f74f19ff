"""Search over model parameters as tables: proposals, unique trials, objectives, pruning and resuming, each one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def uniform(label: Column) -> Column:
    """A number in [0, 1) that depends on the label alone: the first 32 bits of its SHA-256."""
    return F.conv(F.substring(F.sha2(label, 256), 1, 8), 16, 10).cast("double") / 2**32


def proposals(spark: SparkSession, run: str, trials: int, space: dict[str, tuple[float, float, int]]) -> DataFrame:
    """(trial, <parameters>): for each trial and parameter (low, high, places) a value drawn by run, trial and name (never a
    negative zero), so that a run can be repeated or continued from any trial."""
    rows = spark.range(1, trials + 1).select(F.col("id").cast("int").alias("trial"))
    draw = lambda name: uniform(F.concat_ws("|", F.lit(run), F.col("trial").cast("string"), F.lit(name)))
    return rows.select("trial", *[(F.round(F.lit(low) + (high - low) * draw(name), places) + 0.0).alias(name) for name, (low, high, places) in space.items()])


def parameter_hash(names: list[str], places: int = 6) -> Column:
    return F.sha2(F.concat_ws("|", *[F.format_string(f"%.{places}f", F.col(n)) for n in sorted(names)]), 256)


def unique_trials(trials: DataFrame, names: list[str], budget: int) -> DataFrame:
    """trials with parameter_hash, duplicate_of (the first trial with the same parameters, null for the first) and terminal: of the
    first trials of their kind the first budget ones."""
    hashed = trials.withColumn("parameter_hash", parameter_hash(names))
    first = F.min("trial").over(W.partitionBy("parameter_hash"))
    marked = hashed.withColumn("duplicate_of", F.when(first < F.col("trial"), first))
    fresh = F.col("duplicate_of").isNull()
    number = F.sum(fresh.cast("int")).over(W.orderBy("trial").rowsBetween(W.unboundedPreceding, 0))
    return marked.withColumn("terminal", fresh & (number <= budget))


def pending(trials: DataFrame, done: DataFrame) -> DataFrame:
    """The trials whose parameters no finished trial has: what a resumed search still has to do."""
    return trials.join(done.where("state in ('COMPLETE', 'PRUNED')").select("parameter_hash").distinct(), "parameter_hash", "left_anti")


def blend_objectives(rows: DataFrame, trials: DataFrame) -> DataFrame:
    """(trial, fold, n, rmse) of y against weight * a + (1 - weight) * b + shift for every trial and fold.

    The squared error of a blend is a polynomial in its parameters, so that one pass over the rows sums what every trial needs,
    and trials meet a row for each fold instead of all hours.
    """
    u, v = F.col("y") - F.col("b"), F.col("a") - F.col("b")
    sums = {"n": F.count("*"), "uu": F.sum(u * u), "uv": F.sum(u * v), "vv": F.sum(v * v), "su": F.sum(u), "sv": F.sum(v)}
    folds = rows.groupBy("fold").agg(*[s.alias(k) for k, s in sums.items()])
    met = folds.join(F.broadcast(trials.select("trial", "weight", "shift")))
    w, c, n = F.col("weight"), F.col("shift"), F.col("n")
    square = F.col("uu") - 2 * w * F.col("uv") + w * w * F.col("vv") - 2 * c * (F.col("su") - w * F.col("sv")) + c * c * n
    return met.select("trial", "fold", "n", F.sqrt(F.greatest(square, F.lit(0.0)) / n).alias("rmse"))


def pruned(objectives: DataFrame, startup: int) -> DataFrame:
    """(trial, folds_completed, state, objective): a trial stops at the first fold at which the mean of its folds so far is above
    the median of the same mean over the first startup trials; these are never stopped."""
    so_far = F.avg("rmse").over(W.partitionBy("trial").orderBy("fold").rowsBetween(W.unboundedPreceding, 0))
    steps = objectives.withColumn("so_far", so_far)
    median = steps.where(F.col("trial") <= startup).groupBy("fold").agg(F.percentile("so_far", 0.5).alias("median"))
    stops = (F.col("trial") > startup) & (F.col("so_far") > F.col("median"))
    judged = steps.join(F.broadcast(median), "fold")
    got = judged.groupBy("trial").agg(F.min(F.when(stops, F.col("fold"))).alias("stop"), F.max("fold").alias("last"))
    done = steps.join(got, "trial").where(F.col("fold") <= F.coalesce("stop", "last"))
    out = done.groupBy("trial", "stop").agg(F.count("*").alias("folds_completed"), F.max_by("so_far", "fold").alias("mean"))
    state = F.when(F.col("stop").isNull(), "COMPLETE").otherwise("PRUNED")
    return out.select("trial", "folds_completed", state.alias("state"), F.when(F.col("stop").isNull(), F.col("mean")).alias("objective"))


def ranked_features(frame: DataFrame, features: list[str], label: str, least: int = 4, share: float = 0.25) -> DataFrame:
    """(feature, score, rank, chosen): features by the size of their correlation with the label, the best max(least, share) chosen;
    one aggregate over the frame."""
    got = frame.agg(*[F.abs(F.corr(f, label)).alias(f) for f in features])
    each = got.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.coalesce(F.col(f), F.lit(0.0)).alias("score")) for f in features])).alias("r")).select("r.*")
    rank = F.row_number().over(W.orderBy(F.desc(F.round("score", 9)), "feature"))
    return each.withColumn("rank", rank).withColumn("chosen", F.col("rank") <= max(least, round(share * len(features))))


def prepared(train: DataFrame, rows: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """rows with nulls of numeric columns filled by train's medians, and categorical columns as whole numbers in the order of train's
    sorted values, -1 for values that train does not have; nothing is learned from rows themselves."""
    medians = train.agg(*[F.percentile(c, 0.5).alias(f"_{c}") for c in numeric])
    out = rows.join(F.broadcast(medians)).withColumns({c: F.coalesce(c, f"_{c}") for c in numeric}).drop(*[f"_{c}" for c in numeric])
    for c in categorical:
        codes = train.select(F.col(c).alias("_v")).where("_v is not null").distinct()
        codes = codes.withColumn("_k", F.row_number().over(W.orderBy("_v")) - 1)
        out = out.join(F.broadcast(codes), F.col(c) == F.col("_v"), "left").withColumn(c, F.coalesce("_k", F.lit(-1))).drop("_v", "_k")
    return out
