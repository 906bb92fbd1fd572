"""Sessions of keys over event time, with late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery


def sessions(events: DataFrame, key: str, gap: str, lateness: str) -> DataFrame:
    """(key, first, last, n): stretches of a key's events no more than ``gap`` apart.

    A row may come ``lateness`` later than the newest one seen; what comes later
    still is dropped. A session is emitted once no row can reach it any more. Works on tables too.
    """
    timed = events.withWatermark("ts", lateness) if events.isStreaming else events
    return (timed.groupBy(F.session_window("ts", gap).alias("w"), F.col(key))
            .agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n")).drop("w"))


def session_stream(events: DataFrame, key: str, gap: str, lateness: str, path: str, checkpoint: str) -> StreamingQuery:
    """Closed sessions to ``path``, exactly once."""
    return (sessions(events, key, gap, lateness).writeStream.outputMode("append").format("parquet")
            .option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
