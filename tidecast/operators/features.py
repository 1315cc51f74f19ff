"""Lags and rolling statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lag_features(obs: DataFrame, lags: list[int], keys: tuple[str, ...] = ("target",), ts: str = "ts", y: str = "y") -> DataFrame:
    """lag_k for each k: the value k rows before, within the series."""
    w = W.partitionBy(*keys).orderBy(ts)
    return obs.withColumns({f"lag_{k}": F.lag(y, k).over(w) for k in lags})


def rolling_features(obs: DataFrame, widths: list[int], keys: tuple[str, ...] = ("target",), ts: str = "ts", y: str = "y") -> DataFrame:
    """rmean_w and rstd_w over the w rows before each row; the deviation is null until there are two."""
    out = obs
    for w in widths:
        frame = W.partitionBy(*keys).orderBy(ts).rowsBetween(-w, -1)
        out = out.withColumns({f"rmean_{w}": F.avg(y).over(frame), f"rstd_{w}": F.stddev_samp(y).over(frame)})
    return out


def rolling_by_time(obs: DataFrame, hours: int, population: bool = False, keys: tuple[str, ...] = ("target",), ts: str = "ts", y: str = "y") -> DataFrame:
    """Mean and deviation over the stamps from `hours` to one hour before; gaps simply hold fewer values."""
    second = F.col(ts).cast("timestamp").cast("long")
    frame = W.partitionBy(*keys).orderBy(second).rangeBetween(-hours * 3600, -3600)
    deviation = F.stddev_pop if population else F.stddev_samp
    return obs.withColumns({"rmean": F.avg(y).over(frame), "rstd": deviation(y).over(frame), "n_back": F.count(y).over(frame)})


def seasonal_shift(obs: DataFrame, hours: int, keys: tuple[str, ...] = ("target",), ts: str = "ts", y: str = "y", name: str = "y_pred") -> DataFrame:
    """The value at exactly `hours` before, by an equi-join on the shifted stamp; rows without it go."""
    before = obs.select(*keys, F.expr(f"{ts} + interval {hours} hours").alias(ts), F.col(y).alias(name))
    return obs.join(before, [*keys, ts])


def observed_or_predicted(obs: DataFrame, predictions: DataFrame, cutoff: str, keys: tuple[str, ...] = ("target", "ts")) -> DataFrame:
    """The observation up to the cutoff, the prediction after it; (keys, value, source)."""
    both = obs.join(predictions, list(keys), "full")
    seen = F.col("ts") <= F.lit(cutoff).cast("timestamp_ntz")
    return both.select(*keys, F.when(seen, F.col("y")).otherwise(F.col("y_pred")).alias("value"), F.when(seen, "observed").otherwise("predicted").alias("source"))


def rolling_recursive(values: DataFrame, widths: list[int], start: str, end: str) -> DataFrame:
    """(target, ts, rmean_w, rstd_w, missing_w) for the hours from start to end: statistics over exactly the w hours before.

    values are (target, ts, value), observed up to a cutoff and predicted after it; missing_w counts the hours of the window
    that have no finite value.  Nothing is filled in: a caller for whom they must be there asks for missing_w = 0.
    """
    seen = F.when(~F.isnan("value") & (F.abs("value") < F.lit(float("inf"))), F.col("value"))
    out = values.withColumn("_v", seen)
    for w in widths:
        frame = W.partitionBy("target").orderBy(F.col("ts").cast("timestamp").cast("long")).rangeBetween(-w * 3600, -3600)
        out = out.withColumns({f"rmean_{w}": F.avg("_v").over(frame), f"rstd_{w}": F.stddev_samp("_v").over(frame), f"missing_{w}": F.lit(w) - F.count("_v").over(frame)})
    span = (F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    return out.where(span).select("target", "ts", *[f"{n}_{w}" for w in widths for n in ("rmean", "rstd", "missing")])


def first_of_each_column(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left and right side by side on the key; of a column that both have, left's stays."""
    return left.join(right.select(key, *[c for c in right.columns if c not in left.columns]), key)
