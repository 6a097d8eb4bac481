"""Streaming counterparts of the calendar audit and yearly flows: event-time windows under a watermark. An addition, not among the inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, ts: str) -> DataFrame:
    """Watermarks need timestamps with a time zone."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def daily_counts(events: DataFrame, ts: str = "ts", late: str = "2 days") -> DataFrame:
    """(day, n) per calendar day; a day is emitted once the watermark has passed it."""
    return _timed(events, ts).withWatermark(ts, late).groupBy(F.window(ts, "1 day")).agg(F.count(F.lit(1)).alias("n")).select(F.to_date(F.col("window.start")).alias("day"), "n")


def sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """(key, start, end, n) of activity sessions."""
    return _timed(events, ts).withWatermark(ts, late).groupBy(key, F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
