"""Counts of events by windows of event time, on tables and on streams.

On a stream a watermark says how late an event may be; later ones are dropped and windows that it has passed
are emitted once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _late(events: DataFrame, at: str, lateness: str) -> DataFrame:
    return events.withWatermark(at, lateness) if events.isStreaming else events


def window_counts(events: DataFrame, at: str, width: str, slide: str | None = None, by: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """(start, by, n, total): tumbling windows of ``width``, sliding ones where ``slide`` is given."""
    keys = [F.window(at, width, slide) if slide else F.window(at, width), *([F.col(by)] if by else [])]
    counted = _late(events, at, lateness).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("start"), *([by] if by else []), "n", "total")


def sessions(events: DataFrame, at: str, gap: str, by: str, lateness: str = "1 hour") -> DataFrame:
    """(by, start, end, n): events of one ``by`` with less than ``gap`` between them."""
    counted = _late(events, at, lateness).groupBy(by, F.session_window(at, gap)).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def run_once(stream: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Process all that there is, append closed windows to Parquet files, and stop; started again, it goes on."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(output)
