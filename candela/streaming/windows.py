"""Event-time windows; every plan works on streams and on finished tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events with a zoned timestamp and a watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def windowed(events: DataFrame, window: Column, *keys: str) -> DataFrame:
    out = timed(events).groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("value").alias("peak"))
    return out.select(*keys, F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n",
        F.round("total", 6).alias("total"), "peak")


def tumbling(events: DataFrame, size: str = "1 hour") -> DataFrame:
    return windowed(events, F.window("ts", size), "event_type")


def sliding(events: DataFrame, size: str = "2 hours", step: str = "1 hour") -> DataFrame:
    return windowed(events, F.window("ts", size, step), "event_type")


def sessions(events: DataFrame, gap: str = "2 hours") -> DataFrame:
    return windowed(events, F.session_window("ts", gap), "user_id")
