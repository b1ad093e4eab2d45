"""Event-time windows over a stream or a table of events (t timestamp, ..): tumbling, sliding and session ones, with a bound on lateness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, by: list[str], size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, by.., n): events by window. On a stream, events later than `late` behind the greatest time seen are dropped."""
    marked = events.withWatermark("t", late) if events.isStreaming else events
    out = marked.groupBy(F.window("t", size, slide or size).alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), *by, "n")


def sessions(events: DataFrame, by: list[str], gap: str, late: str = "1 hour") -> DataFrame:
    """(start, end, by.., n): runs of events without a pause of `gap` or more; end is that long after the last event."""
    marked = events.withWatermark("t", late) if events.isStreaming else events
    out = marked.groupBy(F.session_window("t", gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")
