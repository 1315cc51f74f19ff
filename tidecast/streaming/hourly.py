"""Hourly sums of a stream of events, with late data up to a watermark; the batch operator over the same rows is equal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def hourly_stream(events: DataFrame, delay: str = "2 hours") -> DataFrame:
    """(ts, event_type, n, total) for tumbling hours; events: a stream with ts, event_type and value."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    hours = rows.groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return hours.select(F.col("w.start").cast("timestamp_ntz").alias("ts"), "event_type", "n", "total")


def hourly_batch(events: DataFrame) -> DataFrame:
    """The same rows from a finished table."""
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    return events.groupBy(hour.alias("ts"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def write_stream(hours: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends hours as they close; the checkpoint lets a restarted query go on where it stopped."""
    return hours.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
