"""Diebold-Mariano tests over all pairs of models: one grouping by the keys, then grouped aggregates; Holm adjustment by windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pair_differences(losses: DataFrame, keys: list[str], value: str = "loss") -> DataFrame:
    """(keys, model_a, model_b, d) for a < b: the models of a key are gathered once and paired there; models are few, keys are many.

    Both losses of a pair come from one evaluation of the input, so that equal losses differ by nothing."""
    met = losses.dropna(subset=keys).groupBy(*keys).agg(F.collect_list(F.struct(F.col("model_id").alias("m"), F.col(value).alias("v"))).alias("_s"))
    pairs = F.flatten(F.transform("_s", lambda a: F.transform(F.filter("_s", lambda b: a["m"] < b["m"]), lambda b: F.struct(a["m"].alias("model_a"), b["m"].alias("model_b"), (a["v"] - b["v"]).alias("d")))))
    return met.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.model_a", "_p.model_b", "_p.d")


def planned_differences(losses: DataFrame, contrasts: DataFrame, keys: list[str], value: str = "loss") -> DataFrame:
    """(contrast, model_a, model_b, keys, d) for the planned contrasts alone, in the order that each states; contrasts are few
    rows and are broadcast."""
    a = losses.select(*keys, F.col("model_id").alias("model_a"), F.col(value).alias("_a"))
    b = losses.select(*keys, F.col("model_id").alias("model_b"), F.col(value).alias("_b"))
    met = a.join(F.broadcast(contrasts), "model_a").join(b, [*keys, "model_b"])
    return met.select("contrast", "model_a", "model_b", *keys, (F.col("_a") - F.col("_b")).alias("d"))


def _beyond(theta: Column, df: Column) -> Column:
    """P(|T| > sqrt(df) tan theta) for whole degrees of freedom, by the finite trigonometric series (Abramowitz and Stegun 26.7.3-4)."""
    c2 = F.pow(F.cos(theta), 2)

    def series(first: Column, count: Column, up: int) -> Column:
        """first (1 + r1 c2 (1 + r2 c2 (...))): count terms; each term is the one before times c2 (2k - up) / (2k - up + 1)."""
        terms = F.aggregate(
            F.when(count >= 2, F.sequence(F.lit(1), (count - 1).cast("int"))).otherwise(F.array().cast("array<int>")),
            F.struct(first.alias("term"), first.alias("total")),
            lambda s, k: F.struct((s["term"] * c2 * (2 * k - up) / (2 * k - up + 1)).alias("term"), (s["total"] + s["term"] * c2 * (2 * k - up) / (2 * k - up + 1)).alias("total")),
            lambda s: s["total"],
        )
        return F.when(count >= 1, terms).otherwise(F.lit(0.0))

    odd = (2 / F.lit(3.141592653589793)) * (theta + F.sin(theta) * series(F.cos(theta), F.floor((df - 1) / 2), 0))
    even = F.sin(theta) * series(F.lit(1.0), F.floor(df / 2), 1)
    return F.greatest(F.lit(0.0), 1 - F.when(df % 2 == 1, odd).otherwise(even))


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| > |t|) for whole degrees of freedom."""
    return _beyond(F.atan(F.abs(t) / F.sqrt(df.cast("double"))), df)


def t_critical(df: Column, alpha: float = 0.05) -> Column:
    """The t that |T| exceeds with probability alpha, by halving the angle's range until it is as narrow as a double can be."""

    def halve(s: Column, _: Column) -> Column:
        middle = (s["low"] + s["high"]) / 2
        out = _beyond(middle, df) > alpha
        return F.struct(F.when(out, middle).otherwise(s["low"]).alias("low"), F.when(out, s["high"]).otherwise(middle).alias("high"))

    ends = F.struct(F.lit(0.0).alias("low"), F.lit(1.5707963267948966).alias("high"))
    return F.sqrt(df.cast("double")) * F.tan(F.aggregate(F.sequence(F.lit(1), F.lit(55)), ends, halve, lambda s: s["low"]))


def auto_lag(n: Column) -> Column:
    """floor(4 (n / 100)^(2/9)), between 0 and n - 2."""
    return F.greatest(F.lit(0), F.least(F.floor(4 * F.pow(n / F.lit(100.0), F.lit(2 / 9))), n - 2)).cast("int")


def dm_tests(differences: DataFrame, keys: list[str], order: str, lag: int | None = None, least: int = 5, horizon: int = 1, most_lag: int = 30) -> DataFrame:
    """(keys, n, mean_difference, hac_lag, statistic, p_value, standard_error, status) for each group of differences.

    The long-run variance sums autocovariances (population form) up to the lag with weights 1 - l / (lag + 1); the statistic
    carries the small-sample factor of Harvey, Leybourne and Newbold for the horizon.  A group's series is one sorted array.
    """
    got = differences.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "d"))), lambda x: x["d"]).alias("s"))
    got = got.withColumn("n", F.size("s").cast("long"))
    got = got.withColumn("mean_difference", F.aggregate("s", F.lit(0.0), lambda a, x: a + x) / F.col("n"))
    got = got.withColumn("hac_lag", auto_lag(F.col("n")) if lag is None else F.greatest(F.lit(0), F.least(F.lit(lag), F.col("n") - 2)).cast("int"))
    got = got.withColumn("c", F.transform("s", lambda x: x - F.col("mean_difference")))

    def covariance(ell: Column) -> Column:
        ahead = F.slice("c", ell + 1, F.greatest(F.col("n").cast("int") - ell, F.lit(0)))
        base = F.slice("c", F.lit(1), F.greatest(F.col("n").cast("int") - ell, F.lit(0)))
        return F.aggregate(F.zip_with(ahead, base, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x) / F.col("n")

    lags = F.when(F.col("hac_lag") >= 1, F.sequence(F.lit(1), F.col("hac_lag"))).otherwise(F.array().cast("array<int>"))
    tail = F.aggregate(lags, F.lit(0.0), lambda a, ell: a + 2 * (1 - ell / (F.col("hac_lag") + 1.0)) * covariance(ell))
    got = got.withColumn("variance", (covariance(F.lit(0)) + tail) / F.col("n"))
    got = got.withColumn("spread", F.aggregate("s", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x))))
    n = F.col("n").cast("double")
    got = got.withColumn("hln", F.sqrt(F.greatest(F.lit(0.0), (n + 1 - 2 * horizon + horizon * (horizon - 1) / n) / n)))
    status = F.when(F.col("n") < least, "insufficient sample").when(F.col("spread") <= 1e-12, "identical losses").when(F.col("variance") <= 1e-15, "invalid HAC variance").when(F.col("hln") <= 0, "invalid HLN factor").otherwise("ok")
    got = got.withColumn("status", status)
    ok = F.col("status") == "ok"
    got = got.withColumn("standard_error", F.when(ok, F.sqrt("variance") / F.col("hln"))).withColumn("statistic", F.when(ok, F.try_divide("mean_difference", "standard_error")))
    p = F.when(ok, t_two_sided(F.col("statistic"), F.col("n") - 1)).when(F.col("status") == "identical losses", F.lit(1.0))
    return got.withColumn("p_value", p).select(*keys, "n", "mean_difference", "hac_lag", "statistic", "p_value", "standard_error", "status")


def holm(df: DataFrame, family: list[str], p: str = "p_value", out: str = "p_holm", ties: list[str] | None = None) -> DataFrame:
    """Holm's step-down adjustment within each family; null p values stay null and are not counted."""
    order = [F.col(p).asc_nulls_last(), *[F.col(t) for t in ties or []]]
    ranked = W.partitionBy(*family).orderBy(*order)
    m, k = F.count(p).over(W.partitionBy(*family)), F.row_number().over(ranked)
    step = df.withColumn("_s", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), (m - k + 1) * F.col(p))))
    running = F.max("_s").over(ranked.rowsBetween(W.unboundedPreceding, 0))
    return step.withColumn(out, F.when(F.col(p).isNotNull(), running)).drop("_s")


def with_bounds(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """tests with ci_low and ci_high of the mean difference; critical values are found once for each sample size."""
    critical = tests.where("status = 'ok'").select("n").distinct().withColumn("t", t_critical(F.col("n") - 1, alpha))
    half = F.col("t") * F.col("standard_error")
    return tests.join(F.broadcast(critical), "n", "left").withColumns({"ci_low": F.col("mean_difference") - half, "ci_high": F.col("mean_difference") + half}).drop("t")


def oriented(pairs: DataFrame, selected: str) -> DataFrame:
    """Pairs with the selected model as selected minus comparator: differences, statistics and bounds change sign with the order."""
    first = F.col("model_a") == selected
    chosen = pairs.where(first | (F.col("model_b") == selected))
    turned = {c: F.when(first, F.col(c)).otherwise(-F.col(c)) for c in ("mean_difference", "statistic")}
    turned |= {"ci_low": F.when(first, F.col("ci_low")).otherwise(-F.col("ci_high")), "ci_high": F.when(first, F.col("ci_high")).otherwise(-F.col("ci_low"))}
    return chosen.withColumns({"comparator": F.when(first, F.col("model_b")).otherwise(F.col("model_a")), **turned})


def better_model(df: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The model with the smaller loss, where the adjusted p value is below alpha."""
    chosen = F.when(F.col("mean_difference") < 0, F.col("model_a")).when(F.col("mean_difference") > 0, F.col("model_b"))
    return df.withColumn("better_model", F.when(F.col("p_holm") < alpha, chosen))


def league(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, model_id, wins, losses, net, undecided): each pair is turned to both its models."""
    each = pairs.select(*keys, F.explode(F.array("model_a", "model_b")).alias("model_id"), "better_model")
    win, loss = F.col("better_model") == F.col("model_id"), F.col("better_model").isNotNull() & (F.col("better_model") != F.col("model_id"))
    got = each.groupBy(*keys, "model_id").agg(F.sum(F.coalesce(win, F.lit(False)).cast("long")).alias("wins"), F.sum(loss.cast("long")).alias("losses"), F.sum(F.col("better_model").isNull().cast("long")).alias("undecided"))
    return got.withColumn("net", F.col("wins") - F.col("losses"))


def matrix_cells(pairs: DataFrame, keys: list[str], value: str, antisymmetric: bool, diagonal: float) -> DataFrame:
    """(keys, row, col, value): both triangles and the diagonal, long; a pivot makes it square at the sink."""
    there = pairs.select(*keys, F.col("model_a").alias("row"), F.col("model_b").alias("col"), F.col(value).alias("value"))
    back = pairs.select(*keys, F.col("model_b").alias("row"), F.col("model_a").alias("col"), (-F.col(value) if antisymmetric else F.col(value)).alias("value"))
    each = pairs.select(*keys, F.explode(F.array("model_a", "model_b")).alias("row")).distinct()
    return there.unionByName(back).unionByName(each.select(*keys, "row", F.col("row").alias("col"), F.lit(diagonal).alias("value")))
