"""Counts of an event stream in fixed windows, and the keys that go beyond a limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counted(events: DataFrame, key: str, seconds: int, lateness: str = "1 minute", ts: str = "ts") -> DataFrame:
    """(key, start, n) of every window; rows later than ``lateness`` are left out of a stream, null times always.

    Runs on a stream or a table.  The state is one count a key and open window.
    """
    rows = events.filter(F.col(ts).isNotNull())
    rows = rows.withWatermark(ts, lateness) if events.isStreaming else rows
    found = rows.groupBy(key, F.window(ts, f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return found.select(key, F.col("w.start").alias("start"), "n")


def beyond(events: DataFrame, key: str, seconds: int, most: int, lateness: str = "1 minute", ts: str = "ts") -> DataFrame:
    return counted(events, key, seconds, lateness, ts).filter(F.col("n") > most)
