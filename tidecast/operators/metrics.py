"""Point and probabilistic metrics as single aggregates over the long fact table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EPS = 1e-8


def point_metrics(y: str = "y_true", e: str = "error") -> dict[str, Column]:
    """Aggregates by name: n, rmse, mae, mape (rows with |y| above EPS), smape, wmape and bias."""
    yc, ec = F.col(y), F.col(e)
    p = yc - ec
    denominator = F.abs(yc) + F.abs(p)
    return {
        "n": F.count(ec),
        "rmse": F.sqrt(F.avg(ec * ec)),
        "mae": F.avg(F.abs(ec)),
        "mape": 100 * F.avg(F.when(F.abs(yc) > EPS, F.abs(ec) / F.abs(yc))),
        "smape": 100 * F.avg(F.when(denominator > EPS, 2 * F.abs(ec) / denominator)),
        "wmape": 100 * F.try_divide(F.sum(F.abs(ec)), F.sum(F.abs(yc))),
        "bias": F.avg(ec),
    }


def summarise(facts: DataFrame, keys: list[str], names: list[str] | None = None) -> DataFrame:
    got = point_metrics()
    return facts.groupBy(*keys).agg(*[got[n].alias(n) for n in names or got])


def roll_ups(facts: DataFrame, names: list[str]) -> DataFrame:
    """Overall, by date and by horizon, in one pass of grouping sets; level tells which."""
    got = point_metrics()
    sets = [["model_id", "target"], ["model_id", "target", "date"], ["model_id", "target", "horizon"]]
    level = F.when(F.grouping("date") == 0, "date").when(F.grouping("horizon") == 0, "horizon").otherwise("overall")
    return facts.groupingSets([[F.col(c) for c in s] for s in sets], "model_id", "target", "date", "horizon").agg(level.alias("level"), *[got[n].alias(n) for n in names])


def mase_scale(obs: DataFrame, before: str, season: int = 24, drop_missing_first: bool = False) -> DataFrame:
    """(target, scale): the mean absolute difference to the value a season of rows before, over rows before a stamp."""
    past = obs.where(F.col("ts") < F.lit(before).cast("timestamp_ntz"))
    past = past.where("y is not null") if drop_missing_first else past
    shifted = past.withColumn("_d", F.abs(F.col("y") - F.lag("y", season).over(W.partitionBy("target").orderBy("ts"))))
    return shifted.groupBy("target").agg(F.avg("_d").alias("scale"))


def normalised_pair(by_target: DataFrame, keys: list[str], scales: DataFrame, metric: str = "rmse") -> DataFrame:
    """(keys, p, q, joint): both targets' metric and the mean of the two, each over its target's scale."""
    both = by_target.join(F.broadcast(scales), "target").withColumn("_z", F.col(metric) / F.col("scale"))
    return both.groupBy(*keys).agg(F.max(F.when(F.col("target") == "P", F.col(metric))).alias("p"), F.max(F.when(F.col("target") == "Q", F.col(metric))).alias("q"), F.avg("_z").alias("joint"))


def daily_losses(facts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Daily means of squared and absolute errors with the day's point metrics."""
    got = point_metrics()
    e = F.col("error")
    return facts.groupBy(*(keys or ["model_id", "target", "date"])).agg(F.avg(e * e).alias("se"), F.avg(F.abs(e)).alias("ae"), got["rmse"].alias("rmse"), got["mae"].alias("mae"), got["wmape"].alias("wmape"), got["bias"].alias("bias"))


def ordered_means(rows: DataFrame, keys: list[str], order: str, names: list[str], places: int) -> DataFrame:
    """(keys, names): rounded means of groups of few rows, summed in one order, so that equal rows have equal means to the last bit."""
    got = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *names))).alias("_s"))

    def mean(name: str) -> Column:
        there = F.filter(F.col("_s")[name], lambda x: x.isNotNull())
        return F.round(F.try_divide(F.aggregate(there, F.lit(0.0), lambda a, x: a + x), F.size(there)), places)

    return got.select(*keys, *[mean(n).alias(n) for n in names])


def regimes(facts: DataFrame, split: str) -> DataFrame:
    """Facts with their regime, before or from a day, and once more as `overall`."""
    regime = F.when(F.col("date") < F.lit(split).cast("date"), F.lit(f"before_{split}")).otherwise(F.lit(f"from_{split}"))
    return facts.withColumn("regime", F.explode(F.array(regime, F.lit("overall"))))


def percentage_errors(facts: DataFrame, keys: list[str]) -> DataFrame:
    """The published variants of MAPE, SMAPE and WMAPE: a floor for small denominators, only rows above EPS, or EPS added."""
    y, p, e = F.abs("y_true"), F.abs("y_pred"), F.abs("error")
    both = y + p
    shares = {
        "mape_floor": e / F.greatest(y, F.lit(2.220446049250313e-16)),
        "mape_rows": F.when(y > EPS, e / y),
        "mape_plus": e / (y + EPS),
        "smape_plus": 2 * e / (both + EPS),
        "smape_rows": F.when(both > EPS, 2 * e / both),
        "smape_floor": 2 * e / F.greatest(both, F.lit(EPS)),
    }
    totals = {"wmape": 100 * F.try_divide(F.sum(e), F.sum(y)), "wmape_plus": 100 * F.sum(e) / (F.sum(y) + EPS)}
    return facts.groupBy(*keys).agg(*[(100 * F.avg(v)).alias(k) for k, v in shares.items()], *[v.alias(k) for k, v in totals.items()])


def with_made_crps(losses: DataFrame, quantiles: DataFrame) -> DataFrame:
    """losses with crps filled from quantiles' pinball losses where a model has none stored, and crps_source."""
    from tidecast.operators.probabilistic import crps_from_quantiles

    key = ["model_id", "target", "ts"]
    made = crps_from_quantiles(quantiles, key).withColumnRenamed("crps", "_made")
    source = F.when(F.col("crps").isNotNull(), "stored").otherwise("made from quantiles")
    return losses.join(made, key, "left").withColumn("crps_source", source).withColumn("crps", F.coalesce("crps", "_made")).drop("_made")
