"""Day-ahead point forecasts as one long fact table: (model_id, target, ts, date, horizon, y_true, y_pred, error)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.operators.features import seasonal_shift

HORIZON = 24


def as_facts(df: DataFrame, model_id: str) -> DataFrame:
    """Rows (target, ts, y, y_pred) as facts of a model; the horizon counts the hours of the day from 1."""
    return df.select(F.lit(model_id).alias("model_id"), "target", "ts", F.to_date("ts").alias("date"), (F.hour("ts") + 1).alias("horizon"), F.col("y").alias("y_true"), "y_pred", (F.col("y") - F.col("y_pred")).alias("error"))


def in_period(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of the days from start to end, both included."""
    return df.where((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.expr(f"timestamp_ntz '{end}' + interval 1 day")))


def whole_days(df: DataFrame) -> DataFrame:
    """Rows of the days of a model and target that have every horizon: counted and joined back."""
    days = df.groupBy("model_id", "target", "date").agg(F.count("*").alias("n")).where(F.col("n") == HORIZON).drop("n")
    return df.join(days, ["model_id", "target", "date"], "left_semi")


def seasonal_naive(obs: DataFrame, lag: int, model_id: str | None = None) -> DataFrame:
    """Every horizon from the value lag hours before; the lag covers the horizon."""
    if lag < HORIZON:
        raise ValueError("the lag is shorter than the horizon")
    return as_facts(seasonal_shift(obs, lag), model_id or f"naive{lag}")


def previous_day_mean(obs: DataFrame, model_id: str = "mean24") -> DataFrame:
    """All horizons get the mean of the day before."""
    days = obs.groupBy("target", F.to_date("ts").alias("date")).agg(F.avg("y").alias("y_pred"))
    days = days.select("target", F.date_add("date", 1).alias("date"), "y_pred")
    return as_facts(obs.withColumn("date", F.to_date("ts")).join(days, ["target", "date"]).drop("date"), model_id)


def same_hour_mean(obs: DataFrame, days: int = 7, model_id: str = "hourmean7d") -> DataFrame:
    """The mean of the same hour over the days before, where all of them are there: one row is sent to each day it serves."""
    sent = obs.select("target", F.col("y").alias("v"), F.explode(F.sequence(F.lit(1), F.lit(days))).alias("k"), F.col("ts").alias("t"))
    sent = sent.select("target", F.expr("t + make_dt_interval(k)").alias("ts"), "v").groupBy("target", "ts").agg(F.avg("v").alias("y_pred"), F.count("v").alias("n"))
    return as_facts(obs.join(sent.where(F.col("n") == days).drop("n"), ["target", "ts"]), model_id)


def all_models(obs: DataFrame, start: str, end: str) -> DataFrame:
    """The facts of all baseline models over a period, with one deliberate duplicate, from one pass over the observations.

    Each row is sent to the same hour of the seven days after it, so that both naive lags and the hourly mean come from one
    aggregate and one join; the models are then unpivoted.  The result is the union of the single models' facts.
    """
    sent = obs.select("target", F.col("y").alias("v"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("k"), F.col("ts").alias("t"))
    sent = in_period(sent.select("target", F.expr("t + make_dt_interval(k)").alias("ts"), "k", "v"), start, end)
    back = sent.groupBy("target", "ts").agg(F.max(F.when(F.col("k") == 1, F.col("v"))).alias("naive24"), F.max(F.when(F.col("k") == 7, F.col("v"))).alias("naive168"), F.avg("v").alias("m"), F.count("v").alias("n"))
    days = obs.groupBy("target", F.to_date("ts").alias("date")).agg(F.avg("y").alias("mean24"))
    days = days.select("target", F.date_add("date", 1).alias("date"), "mean24")
    rows = in_period(obs, start, end).join(back, ["target", "ts"], "left").withColumn("date", F.to_date("ts")).join(days, ["target", "date"], "left")
    rows = rows.withColumn("hourmean7d", F.when(F.col("n") == 7, F.col("m")))
    each = "stack(5, 'naive24', naive24, 'naive168', naive168, 'mean24', mean24, 'hourmean7d', hourmean7d, 'dup_naive24', naive24) as (model_id, y_pred)"
    long = rows.select("target", "ts", "date", "y", F.expr(each)).where("y_pred is not null")
    return long.select("model_id", "target", "ts", "date", (F.hour("ts") + 1).alias("horizon"), F.col("y").alias("y_true"), "y_pred", (F.col("y") - F.col("y_pred")).alias("error"))


def joint_recursion(history: DataFrame, steps: int, weights: dict[str, tuple[float, float, float]]) -> DataFrame:
    """(origin, target, horizon, y_pred): a joint linear recursion of two targets in one fold per origin.

    history: (origin, p, q) arrays of the last 24 values, oldest first.  Each target's next value is weights[target] =
    (own last, own 24 before, other's last); both are predicted from the same past before either is appended.
    """

    def step(acc: Column, _: Column) -> Column:
        p, q = acc["p"], acc["q"]

        def value(own: Column, other: Column, w: tuple[float, float, float]) -> Column:
            return F.lit(w[0]) * F.element_at(own, -1) + F.lit(w[1]) * F.element_at(own, -24) + F.lit(w[2]) * F.element_at(other, -1)

        return F.struct(F.concat(p, F.array(value(p, q, weights["P"]))).alias("p"), F.concat(q, F.array(value(q, p, weights["Q"]))).alias("q"))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct("p", "q"), step)
    out = history.select("origin", done.alias("s")).select("origin", F.posexplode(F.arrays_zip(F.slice("s.p", -steps, steps).alias("p"), F.slice("s.q", -steps, steps).alias("q"))).alias("k", "v"))
    return out.select("origin", (F.col("k") + 1).alias("horizon"), F.expr("stack(2, 'P', v.p, 'Q', v.q) as (target, y_pred)"))
