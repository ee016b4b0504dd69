"""Tumbling and session windows over events in time order, for streams and tables alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(events: DataFrame, time: str = "ts", every: str = "1 hour", late: str = "1 hour", keys: tuple[str, ...] = ("event_type",), value: str = "value") -> DataFrame:
    """Events, and the sum of their values, per key and window. On a stream, windows close ``late`` after their end."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    timed = timed.withWatermark(time, late) if events.isStreaming else timed
    out = timed.groupBy(F.window(time, every), *keys).agg(F.count("*").alias("n_events"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), *keys, "n_events", "total")


def session_counts(events: DataFrame, time: str = "ts", gap: str = "30 minutes", late: str = "1 hour", key: str = "user_id") -> DataFrame:
    """Events per user and session; a session ends after ``gap`` without an event."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    timed = timed.withWatermark(time, late) if events.isStreaming else timed
    out = timed.groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n_events"))
    return out.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n_events")
