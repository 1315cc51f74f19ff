"""Reading tables, and the hourly pair that plays the part of the load series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How a timestamp is written out, so that engines agree on it.
STAMP = "yyyy-MM-dd HH:mm:ss"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hour_of(column: str) -> F.Column:
    return F.date_trunc("hour", F.col(column).cast("timestamp")).cast("timestamp_ntz")


def hourly_grid(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """Every hour from the first to the last one of rows, once."""
    ends = rows.agg(F.min(ts).alias("a"), F.max(ts).alias("b"))
    return ends.select(F.explode(F.expr("sequence(a, b, interval 1 hour)")).alias(ts))


def hourly_sums(events: DataFrame) -> DataFrame:
    """(ts, p, q) for the hours that have events: all values, and those of clicks and views."""
    chosen = F.when(F.col("event_type").isin("click", "view"), F.col("value"))
    return events.groupBy(hour_of("ts").alias("ts")).agg(F.sum("value").alias("p"), F.sum(chosen).alias("q"))


def hourly_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, p, q) on the full grid; hours without events are zero."""
    sums = hourly_sums(table(spark, sf_dir, "events"))
    return hourly_grid(sums).join(sums, "ts", "left").select("ts", F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))


def observations(pair: DataFrame) -> DataFrame:
    """(target, ts, y): the pair in long form."""
    return pair.select("ts", F.expr("stack(2, 'P', p, 'Q', q) as (target, y)")).select("target", "ts", "y")
