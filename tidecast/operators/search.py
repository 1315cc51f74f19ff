"""Aggregates over search trials and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed weights of the strata.
STRATA = {"regular": 0.50, "calendar": 0.25, "stress": 0.25}


def aggregate_targets(df: DataFrame, keys: list[str], value: str, mode: str = "mean", weight: str = "weight") -> DataFrame:
    """The targets' metric as one: their mean, weighted mean or maximum."""
    how = {"mean": F.avg(value), "max": F.max(value), "weighted": F.try_divide(F.sum(F.col(weight) * F.col(value)), F.sum(weight))}[mode]
    return df.groupBy(*keys).agg(how.alias("objective"))


def stratified_objective(folds: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """The weighted mean of the strata's means, renormalised over the strata that are there."""
    weight = F.create_map(*[F.lit(x) for kv in STRATA.items() for x in kv])
    means = folds.groupBy(*keys, "stratum").agg(F.avg(value).alias("m")).withColumn("w", weight[F.col("stratum")])
    return means.groupBy(*keys).agg((F.sum(F.col("w") * F.col("m")) / F.sum("w")).alias("objective"))


def components(folds: DataFrame, value: str = "value") -> DataFrame:
    """Means by stratum, by gap and by both, in one pass."""
    return folds.groupingSets([[F.col("stratum")], [F.col("gap")], [F.col("stratum"), F.col("gap")]], "stratum", "gap").agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def progress(trials: DataFrame, run: str = "run_id", order: str = "trial") -> DataFrame:
    """Best objective so far, which only complete trials lower, and running totals of fits and seconds."""
    w = W.partitionBy(run).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    best = F.min(F.when(F.col("state") == "COMPLETE", F.col("objective"))).over(w)
    return trials.withColumns({"best_so_far": best, "total_fits": F.sum("fits").over(w), "total_seconds": F.sum("seconds").over(w)})


def spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median, sample coefficient of variation and range over median."""
    median = F.percentile(value, 0.5)
    return df.groupBy(*keys).agg(median.alias("median"), F.try_divide(F.stddev_samp(value), F.avg(value)).alias("cv"), F.try_divide(F.max(value) - F.min(value), median).alias("range_over_median"))


def cycle_costs(trials: DataFrame, run: str) -> DataFrame:
    """(run, cycle, candidate_fits, peer_fits, total_fits, seconds, fits_so_far, seconds_so_far, objective) of each cycle."""
    complete = F.col("state") == "COMPLETE"
    fits = lambda kind: F.coalesce(F.sum(F.when(kind, F.col("fits"))), F.lit(0))
    got = trials.groupBy(run, "cycle").agg(fits(complete).alias("candidate_fits"), fits(F.col("state") == "PRUNED").alias("peer_fits"), F.sum("seconds").alias("seconds"), F.min(F.when(complete, F.col("objective"))).alias("objective"))
    got = got.withColumn("total_fits", F.col("candidate_fits") + F.col("peer_fits"))
    w = W.partitionBy(run).orderBy("cycle").rowsBetween(W.unboundedPreceding, 0)
    return got.withColumns({"fits_so_far": F.sum("total_fits").over(w), "seconds_so_far": F.sum("seconds").over(w)})


def milestones(trials: DataFrame, at: tuple[int, ...], run: str = "run_id") -> DataFrame:
    """The progress of each run at the trials `at`, with percent_of_anchor: the best objective against that at the first of them."""
    rows = progress(trials, run).where(F.col("trial").isin(*at))
    anchor = F.first("best_so_far").over(W.partitionBy(run).orderBy("trial").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("_a", anchor).withColumn("percent_of_anchor", 100 * F.try_divide(F.col("best_so_far") - F.col("_a"), F.col("_a"))).drop("_a")


def run_table(trials: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, terminal, complete, best, best_trial, percent_over_best, place): each run against the best of all."""
    complete = F.col("state") == "COMPLETE"
    got = trials.groupBy(run).agg(F.count("*").alias("terminal"), F.count_if(complete).alias("complete"), F.min(F.when(complete, F.struct("objective", "trial"))).alias("b"))
    got = got.select(run, "terminal", "complete", F.col("b.objective").alias("best"), F.col("b.trial").alias("best_trial"))
    every = W.partitionBy()
    return got.withColumns({"percent_over_best": 100 * (F.col("best") / F.min("best").over(every) - 1), "place": F.rank().over(W.orderBy(F.round("best", 9)))})
