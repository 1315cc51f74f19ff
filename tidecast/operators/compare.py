"""Ranking, selection and duplicates of whole systems."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def min_ranks(df: DataFrame, metrics: list[str], keys: tuple[str, ...] = ("target",)) -> DataFrame:
    """rank_m for each metric: equal values share the smallest rank."""
    return df.withColumns({f"rank_{m}": F.rank().over(W.partitionBy(*keys).orderBy(m)) for m in metrics})


def pareto(df: DataFrame, metrics: list[str], key: str = "model_id", group: str = "target") -> DataFrame:
    """df with pareto = 1 where no other row of the group is as good on all metrics and better on one."""
    other = df.select(F.col(group).alias("_g"), F.col(key).alias("_k"), *[F.col(m).alias(f"_{m}") for m in metrics])
    as_good, better = F.lit(True), F.lit(False)
    for m in metrics:
        as_good, better = as_good & (F.col(f"_{m}") <= F.col(m)), better | (F.col(f"_{m}") < F.col(m))
    beaten = df.join(other, (F.col(group) == F.col("_g")) & as_good & better).select(group, key).distinct().withColumn("_beaten", F.lit(1))
    return df.join(beaten, [group, key], "left").withColumn("pareto", F.when(F.col("_beaten").isNull(), 1).otherwise(0)).drop("_beaten")


def select_system(by_target: DataFrame, metric: str = "rmse") -> DataFrame:
    """(model_id, p, q, p_norm, q_norm, score, selected): mean of both targets over the best of each; ties by p, q, id."""
    wide = by_target.groupBy("model_id").agg(F.max(F.when(F.col("target") == "P", F.col(metric))).alias("p"), F.max(F.when(F.col("target") == "Q", F.col(metric))).alias("q"))
    best = wide.agg(F.min("p").alias("mp"), F.min("q").alias("mq"))
    scored = wide.join(F.broadcast(best)).withColumns({"p_norm": F.col("p") / F.col("mp"), "q_norm": F.col("q") / F.col("mq")}).drop("mp", "mq")
    scored = scored.withColumn("score", (F.col("p_norm") + F.col("q_norm")) / 2)
    place = F.row_number().over(W.orderBy(F.round("score", 12), "p", "q", "model_id"))
    return scored.withColumn("selected", (place == 1).cast("int"))


def signatures(facts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, signature): SHA-256 over the ordered forecast content; equal forecasts, whatever their rows' order, are equal."""
    row = F.concat_ws("|", F.date_format("ts", "yyyy-MM-dd HH:mm"), F.round("y_true", 6).cast("decimal(20,6)").cast("string"), F.round("y_pred", 6).cast("decimal(20,6)").cast("string"))
    return facts.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(row)), ";"), 256).alias("signature"))


def collapse_duplicates(signed: DataFrame, group: list[str], priority: str | None = None) -> DataFrame:
    """signed with canonical: the first model, by priority and id, of those with one signature."""
    order = [F.col(priority)] if priority else []
    return signed.withColumn("canonical", F.first("model_id").over(W.partitionBy(*group, "signature").orderBy(*order, "model_id")))


def effects(by_target: DataFrame, metric: str = "rmse") -> DataFrame:
    """(target, a, b, effect) for all ordered pairs: 200 (a - b) / (a + b) per cent."""
    a = by_target.select("target", F.col("model_id").alias("a"), F.col(metric).alias("_a"))
    b = by_target.select("target", F.col("model_id").alias("b"), F.col(metric).alias("_b"))
    return a.join(b, "target").where("a <> b").select("target", "a", "b", (200 * F.try_divide(F.col("_a") - F.col("_b"), F.col("_a") + F.col("_b"))).alias("effect"))


def preferred_systems(ranked: DataFrame, preferred: list[str], most: int, key: str = "model_id", rank: str = "rank") -> DataFrame:
    """(key, place): the preferred systems that are there, in their order, then the others by rank, most in all."""
    wanted = F.array(*[F.lit(p) for p in preferred])
    at = F.array_position(wanted, F.col(key))
    place = F.row_number().over(W.orderBy(F.when(at > 0, at).otherwise(len(preferred) + 1), rank, key))
    return ranked.select(key, place.alias("place")).where(F.col("place") <= most)


def best_sheets(needs: DataFrame, sheets: DataFrame, key: str = "model_id") -> DataFrame:
    """(key, sheet, train_rows): of the sheets that hold all columns a model needs and any training row, the one of most
    training rows, the lowest number if equal; null where none does.  Sheets are few rows and are broadcast."""
    fits = needs.join(F.broadcast(sheets), F.expr("size(array_except(needed, columns)) = 0 and train_rows > 0"), "left")
    best = fits.groupBy(key).agg(F.max_by(F.struct("sheet", "train_rows"), F.struct("train_rows", -F.col("sheet"))).alias("b"))
    return best.select(key, "b.sheet", "b.train_rows")


def from_prediction_minus_actual(rows: DataFrame) -> DataFrame:
    """Facts (model_id, target, ts, date, horizon, y_true, y_pred, error) of rows in the other convention: snapshots, targets by
    their long names, errors as prediction less actual.  Rows whose error is not that difference make the query fail."""
    wrong = F.abs(F.col("error") - (F.col("prediction") - F.col("actual"))) > 1e-6
    error = F.when(wrong, F.raise_error(F.lit("errors are not prediction less actual")).cast("double")).otherwise(-F.col("error"))
    return rows.select(F.col("snapshot").alias("model_id"), F.substring("target", 1, 1).alias("target"), F.col("timestamp").alias("ts"), F.col("origin").alias("date"), "horizon", F.col("actual").alias("y_true"), F.col("prediction").alias("y_pred"), error.alias("error"))


def equal_predictions(facts: DataFrame, tolerance: float) -> DataFrame:
    """(target, model_a, model_b, common, n_a, n_b, equal): pairs of models whose stamps are the same and whose predictions differ
    by no more than the tolerance; one equi-join on the stamps."""
    sizes = facts.groupBy("target", "model_id").agg(F.count("*").alias("n"))
    a = facts.select("target", "ts", F.col("model_id").alias("model_a"), F.col("y_pred").alias("_a"))
    b = facts.select("target", "ts", F.col("model_id").alias("model_b"), F.col("y_pred").alias("_b"))
    met = a.join(b, ["target", "ts"]).where("model_a < model_b").groupBy("target", "model_a", "model_b").agg(F.count("*").alias("common"), F.max(F.abs(F.col("_a") - F.col("_b"))).alias("far"))
    for side in "ab":
        met = met.join(F.broadcast(sizes.select("target", F.col("model_id").alias(f"model_{side}"), F.col("n").alias(f"n_{side}"))), ["target", f"model_{side}"])
    equal = (F.col("common") == F.col("n_a")) & (F.col("common") == F.col("n_b")) & (F.col("far") <= tolerance)
    return met.select("target", "model_a", "model_b", "common", "n_a", "n_b", equal.alias("equal"))
