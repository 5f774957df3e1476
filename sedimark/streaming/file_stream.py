"""File transforms on arriving files: a text source, column expressions, a sink with checkpoints.

Progress, cancelling and resuming are those of the streaming query: a query started again with the same
checkpoint folder goes on after the files it has finished.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_lines(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """path and line of every line of the files that are in ``folder`` or arrive there."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def process(
    spark: SparkSession,
    folder: str,
    output: str,
    checkpoint: str,
    transform: Callable[[DataFrame], DataFrame],
    max_files: int | None = None,
    compression: str = "none",
) -> StreamingQuery:
    """Run ``transform`` over all files there are, writing text, and stop; started again, it takes only new files."""
    lines = transform(read_lines(spark, folder, max_files)).select(F.col("line").alias("value"))
    return (
        lines.writeStream.format("text")
        .option("compression", compression)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(output)
    )


def statistics(query: StreamingQuery) -> dict:
    """Batches, rows and milliseconds of a query so far, from its progress reports."""
    reports = query.recentProgress
    return {
        "batches": len(reports),
        "rows": sum(r["numInputRows"] for r in reports),
        "ms": sum(r["durationMs"].get("triggerExecution", 0) for r in reports),
    }
