"""Structured Streaming over request events: windowed telemetry and running click state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, timestamp: str, by: str, value: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and value sums per event-time window and key; events later than ``late`` are dropped by the watermark."""
    return (
        events.withWatermark(timestamp, late)
        .groupBy(F.window(timestamp, window).alias("w"), F.col(by))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
        .select(F.col("w.start").alias("window_start"), by, "n", "total")
    )


def running_clicks(candidates: DataFrame) -> DataFrame:
    """Clicks per article so far, as a stateful streaming aggregate."""
    return candidates.filter("clicked = 1").groupBy("news_id").agg(F.count(F.lit(1)).alias("clicks"))


def append_log(batches: DataFrame, path: str, checkpoint: str):
    """Starts the telemetry sink: every micro-batch is appended as JSON lines."""
    return batches.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
