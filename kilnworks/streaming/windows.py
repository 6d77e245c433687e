"""Sessions and sliding windows by event time, alike on a table and on a stream.

A row that is later than ``late`` behind the newest time that the stream has seen when its
batch begins changes nothing: its windows are written and their state is gone. State is
that of windows younger than the watermark. Nulls: a row without time or user has no
window. Repeated rows count each. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timely(events: DataFrame, time: str, late: str) -> DataFrame:
    known = events.where(F.col(time).isNotNull()).withColumn(time, F.col(time).cast("timestamp"))
    return known.withWatermark(time, late) if events.isStreaming else known


def sessions(events: DataFrame, user: str, time: str, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """(user, opens, closes, n): runs of a user's events with less than gap between them;
    closes is gap after the last one."""
    rows = _timely(events.where(F.col(user).isNotNull()), time, late)
    found = rows.groupBy(F.session_window(time, gap).alias("w"), F.col(user)).agg(F.count(F.lit(1)).alias("n"))
    return found.select(user, F.col("w.start").alias("opens"), F.col("w.end").alias("closes"), "n")


def sliding(events: DataFrame, key: str, time: str, width: str = "1 day", step: str = "12 hours", late: str = "1 day") -> DataFrame:
    """(key, opens, closes, n): events of each key in windows of width, one every step."""
    found = _timely(events, time, late).groupBy(F.window(time, width, step).alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("n"))
    return found.select(key, F.col("w.start").alias("opens"), F.col("w.end").alias("closes"), "n")
