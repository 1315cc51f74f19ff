"""From error trajectories to quantiles, conformal intervals, pinball losses and CRPS; long form throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The quantile levels .05 to .95 in steps of .05.
TAUS = [round(0.05 * k, 2) for k in range(1, 20)]


def trajectory_cube(facts: DataFrame, horizon: int = 24) -> DataFrame:
    """(model_id, date, horizon, e_p, e_q): paired errors of the days that are complete in both targets."""
    wide = facts.where("error is not null").groupBy("model_id", "date", "horizon").agg(F.max(F.when(F.col("target") == "P", F.col("error"))).alias("e_p"), F.max(F.when(F.col("target") == "Q", F.col("error"))).alias("e_q"))
    wide = wide.where("e_p is not null and e_q is not null")
    days = wide.groupBy("model_id", "date").agg(F.count("*").alias("n")).where(F.col("n") == horizon).drop("n")
    return wide.join(days, ["model_id", "date"], "left_semi")


def ensemble_quantiles(errors: DataFrame, keys: list[str], taus: list[float], value: str = "error") -> DataFrame:
    """(keys, tau, q): linear-interpolation quantiles of each group's errors, all levels in one aggregate."""
    levels = F.array(*[F.lit(t) for t in taus])
    got = errors.groupBy(*keys).agg(F.percentile(value, levels).alias("qs"))
    return got.select(*keys, F.explode(F.arrays_zip(levels.alias("tau"), F.col("qs").alias("q"))).alias("z")).select(*keys, "z.tau", "z.q")


def conformal_bounds(errors: DataFrame, keys: list[str], coverages: list[float], value: str = "error") -> DataFrame:
    """(keys, coverage, lower, upper): order statistics floor((n+1)a/2) and ceil((n+1)(1-a/2)), kept within 1 and n."""
    got = errors.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("s"))
    out = got.withColumn("coverage", F.explode(F.array(*[F.lit(c) for c in coverages]))).withColumn("n", F.size("s"))
    alpha = 1 - F.col("coverage")
    # ranks are rounded to nine places first: (n + 1)(1 - a/2) may stand a rounding error above a whole number
    low = F.greatest(F.lit(1), F.floor(F.round((F.col("n") + 1) * alpha / 2, 9)).cast("int"))
    high = F.least(F.col("n"), F.ceil(F.round((F.col("n") + 1) * (1 - alpha / 2), 9)).cast("int"))
    return out.withColumns({"low": F.least(low, F.col("n")), "high": F.greatest(high, F.lit(1))}).select(*keys, "coverage", F.element_at("s", F.col("low")).alias("lower"), F.element_at("s", F.col("high")).alias("upper"))


def pinball(y: Column, q: Column, tau: Column) -> Column:
    return F.greatest(tau * (y - q), (tau - 1) * (y - q))


def interval_score(y: Column, lower: Column, upper: Column, coverage: Column) -> Column:
    """Width, and 2 / (1 - coverage) for each unit that y lies outside."""
    wide = F.lit(2.0) / (1 - coverage)
    return (upper - lower) + wide * F.greatest(lower - y, F.lit(0.0)) + wide * F.greatest(y - upper, F.lit(0.0))


def crps_ensemble(members: DataFrame, keys: list[str], member: str = "x", y: str = "y") -> DataFrame:
    """(keys, crps): mean |x - y| less the pair term, by sorted weights 2k - n - 1 instead of all pairs."""
    n = F.count("*").over(W.partitionBy(*keys))
    k = F.row_number().over(W.partitionBy(*keys).orderBy(member))
    ranked = members.withColumns({"_n": n, "_k": k})
    pair = F.sum((2 * F.col("_k") - F.col("_n") - 1) * F.col(member)) / (F.max("_n") * F.max("_n"))
    return ranked.groupBy(*keys).agg((F.avg(F.abs(F.col(member) - F.col(y))) - pair).alias("crps"))


def crps_from_quantiles(losses: DataFrame, keys: list[str], tau: str = "tau", loss: str = "pinball") -> DataFrame:
    """(keys, crps): twice the trapezoid of the pinball loss over the levels."""
    w = W.partitionBy(*keys).orderBy(tau)
    area = (F.col(tau) - F.lag(tau).over(w)) * (F.col(loss) + F.lag(loss).over(w)) / 2
    return losses.withColumn("_a", area).groupBy(*keys).agg((2 * F.sum("_a")).alias("crps"))


def predictive(points: DataFrame, pool: DataFrame, taus: list[float], coverages: list[float]) -> tuple[DataFrame, DataFrame]:
    """Quantiles (…, tau, q, pinball) and intervals (…, coverage, lower, upper, covered, width, score) of points.

    The pool's errors (model_id, target, horizon, error) are summarised once for each horizon and only then joined, so that
    no point meets every member of its ensemble.
    """
    keys = ["model_id", "target", "horizon"]
    q = points.join(ensemble_quantiles(pool, keys, taus).withColumnRenamed("q", "eq"), keys)
    q = q.withColumn("q", F.col("y_pred") + F.col("eq")).withColumn("pinball", pinball(F.col("y_true"), F.col("q"), F.col("tau"))).drop("eq")
    i = points.join(conformal_bounds(pool, keys, coverages), keys)
    i = i.withColumns({"lower": F.col("y_pred") + F.col("lower"), "upper": F.col("y_pred") + F.col("upper")})
    y = F.col("y_true")
    i = i.withColumns({"covered": ((y >= F.col("lower")) & (y <= F.col("upper"))).cast("int"), "width": F.col("upper") - F.col("lower"), "score": interval_score(y, F.col("lower"), F.col("upper"), F.col("coverage"))})
    return q, i


def adaptive_pool(points: DataFrame, errors: DataFrame) -> DataFrame:
    """(model_id, target, date, horizon, error): for each evaluated day all errors of days before it."""
    days = points.select("model_id", "target", "date").distinct()
    past = errors.select("model_id", "target", F.col("date").alias("past"), "horizon", "error")
    return days.join(past, ["model_id", "target"]).where("past < date").select("model_id", "target", "date", "horizon", "error")


def quantile_crossings(quantiles: DataFrame, keys: list[str], tolerance: float = 1e-10) -> DataFrame:
    """(model_id, target, crossings): rows with a quantile below the one of the level before."""
    w = W.partitionBy(*keys).orderBy("tau")
    bad = quantiles.withColumn("_d", F.col("q") - F.lag("q").over(w)).groupBy(*keys).agg(F.max((F.col("_d") < -tolerance).cast("int")).alias("bad"))
    return bad.groupBy("model_id", "target").agg(F.sum(F.coalesce("bad", F.lit(0))).cast("long").alias("crossings"))


def hourly_losses(points: DataFrame, pool: DataFrame, taus: list[float]) -> DataFrame:
    """points with se, ae, crps and pb (the mean pinball loss over taus) of each hour, against the pool's errors of its horizon.

    The forecast cancels out of both scores, so that a horizon's sorted errors, their quantiles and the ensemble's own spread are
    made once, as arrays of one row, and every point reads that row: no point is multiplied by members or levels.
    """
    keys = ["model_id", "target", "horizon"]
    levels = F.array(*[F.lit(t) for t in taus])
    known = pool.groupBy(*keys).agg(F.array_sort(F.collect_list("error")).alias("e"), F.percentile("error", levels).alias("q"))
    n = F.size("e")
    pair = F.aggregate(F.transform("e", lambda x, k: (2 * (k + 1) - n - 1) * x), F.lit(0.0), lambda a, x: a + x) / (n * n)
    known = known.withColumns({"pair": pair, "levels": levels})
    err = F.col("error")
    apart = F.aggregate("e", F.lit(0.0), lambda a, x: a + F.abs(x - err)) / n
    each = F.zip_with("levels", "q", lambda t, q: F.greatest(t * (err - q), (t - 1) * (err - q)))
    met = points.join(known, keys).withColumns({"se": err * err, "ae": F.abs(err), "crps": apart - F.col("pair"), "pb": F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / F.size("q")})
    return met.drop("e", "q", "pair", "levels")
