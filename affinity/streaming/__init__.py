"""Streaming forms of the temporal section, beyond what a batch export needs.

Connections arrive with an event time; late ones are taken within the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str = "ts", key: str | None = None, window: str = "30 days", watermark: str = "7 days") -> DataFrame:
    """Rows in each tumbling window, by key if there is one."""
    keys = [F.col(key)] if key else []
    return events.withWatermark(ts, watermark).groupBy(F.window(ts, window), *keys).agg(F.count("*").alias("count")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "count")


def sessions(events: DataFrame, ts: str = "ts", key: str = "user_id", gap: str = "45 days", watermark: str = "7 days") -> DataFrame:
    """Runs of a key's rows without a longer pause: the streaming counterpart of eras."""
    return events.withWatermark(ts, watermark).groupBy(F.session_window(ts, gap), F.col(key)).agg(F.count("*").alias("count")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "count")
