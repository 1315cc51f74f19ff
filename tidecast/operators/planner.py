"""Names that carry meaning, the feature catalogue, and which features a lag policy allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_DYNAMIC = r"_(lag|rmean|rstd)_([0-9]+)$"


def catalogue(features: DataFrame, targets: list[str]) -> DataFrame:
    """(feature, owner, kind, hours): the longest target that begins the name owns it; others are static."""
    owner = F.coalesce(*[F.when(F.col("feature").startswith(t), F.lit(t)) for t in sorted(targets, key=len, reverse=True)])
    kind, hours = F.regexp_extract("feature", _DYNAMIC, 1), F.regexp_extract("feature", _DYNAMIC, 2)
    return features.select("feature", owner.alias("owner"), F.when(kind == "", "static").otherwise(kind).alias("kind"), F.when(hours != "", hours).cast("int").alias("hours"))


def plan(catalogue_rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(target, policy, need_hours, feature, use) for each plan: known at the origin, recalculated on the way, or dropped.

    A lag of at least need_hours is known; shorter lags and rolling statistics are recalculated where the policy lets the
    target use the owner (its own, or with `mutual` any), and dropped otherwise.  Plans are few rows and are broadcast.
    """
    both = catalogue_rows.join(F.broadcast(plans))
    may = (F.col("owner") == F.col("target")) | (F.col("policy") == "mutual")
    use = F.when(F.col("kind") == "static", "known").when((F.col("kind") == "lag") & (F.col("hours") >= F.col("need_hours")) & may, "known").when(F.col("policy") == "drop", "dropped").when(may, "recalculated").otherwise("dropped")
    return both.select("target", "policy", "need_hours", "feature", use.alias("use"))


def clean_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9_.-]+", "_"), "^_+|_+$", "")


def stable_seed(label: Column) -> Column:
    """The first eight hex digits of the label's SHA-256, plus 42, modulo 2^31 - 1."""
    return (F.conv(F.substring(F.sha2(label, 256), 1, 8), 16, 10).cast("long") + 42) % (2**31 - 1)


def seeded(name: Column, seed: int) -> Column:
    return F.regexp_replace(name, r"_t([0-9]+)$", f"_s{seed}_t$1")


def level(name: Column) -> Column:
    """The quantile level in a column's name: Qxx is a percentage, Pinball_x a share."""
    number = F.regexp_extract(name, r"([0-9.]+)$", 1)
    value = F.when(number != "", number).cast("double")
    return F.when(name.startswith("Q"), value / 100).when(name.startswith("Pinball"), value)


def mutual_information(df: DataFrame, a: str, b: str, ties: list[str], bins: int) -> DataFrame:
    """One row: the mutual information, in nats, of a and of b cut into bins of equal counts.

    Bins go by rank, so that b is sorted as a whole: meant for the samples on which features are chosen.
    """
    rows = df.select(F.col(a).alias("a"), F.ntile(bins).over(W.orderBy(b, *ties)).alias("b"))
    cells = rows.groupBy("a", "b").agg(F.count("*").cast("double").alias("n"))
    cells = cells.withColumns({"na": F.sum("n").over(W.partitionBy("a")), "nb": F.sum("n").over(W.partitionBy("b")), "t": F.sum("n").over(W.partitionBy())})
    return cells.agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mutual_information"))
