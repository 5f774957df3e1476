"""File transforms: line, regular-expression, CSV and binary processors, and their statistics."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def process_lines(
    lines: DataFrame, trim: bool = True, drop_empty: bool = False, keep: Column | None = None, replace: tuple[str, str] | None = None,
    prefix: str = "", suffix: str = "", number: bool = False,
) -> DataFrame:
    """Lines (path, line_no, line) through: trim, drop empty, filter, replace, prefix, suffix, number."""
    out = lines.withColumn("line", F.trim("line")) if trim else lines
    out = out.filter(F.length("line") > 0) if drop_empty else out
    out = out.filter(keep) if keep is not None else out
    out = out.withColumn("line", F.replace("line", F.lit(replace[0]), F.lit(replace[1]))) if replace else out
    parts = [F.concat(F.col("line_no").cast("string"), F.lit(": "))] if number else []
    return out.withColumn("line", F.concat(*parts, F.lit(prefix), "line", F.lit(suffix)))


def process_regex(lines: DataFrame, pattern: str, replacement: str | None = None) -> DataFrame:
    """Without a replacement the lines that match; with one all lines, every match replaced."""
    if replacement is None:
        return lines.filter(F.col("line").rlike(pattern))
    return lines.withColumn("line", F.regexp_replace("line", F.lit(pattern), F.lit(replacement)))


def process_csv(lines: DataFrame, columns: list[int], n_columns: int, separator: str = ",") -> DataFrame:
    """Chosen columns (from 0) of lines read as CSV with quotes, trimmed and joined again; a header is a row like others."""
    schema = ", ".join(f"c{k} string" for k in range(n_columns))
    row = F.from_csv("line", F.lit(schema), {"sep": separator, "quote": '"', "escape": '"'})
    picked = [F.trim(F.coalesce(row[f"c{k}"], F.lit(""))) for k in columns]
    return lines.withColumn("line", F.concat_ws(separator, *picked))


def replace_bytes(files: DataFrame, search: bytes, replacement: bytes) -> DataFrame:
    """(path, content, replaced): every occurrence of a byte string replaced, at any alignment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [c or b"" for c in b["content"].to_pylist()]
            new = [d.replace(search, replacement) for d in data]
            counts = pa.array([d.count(search) for d in data], pa.int64())
            yield pa.RecordBatch.from_arrays([b["path"], pa.array(new, pa.binary()), counts], ["path", "content", "replaced"])

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, "path string, content binary, replaced long")


def transform_text(text: Column, *steps: str) -> Column:
    """Steps by name, in order: trim, eol, drop_blank, sort_lines, drop_comments."""
    made = {
        "trim": F.trim,
        "eol": lambda t: F.regexp_replace(t, "\r\n?", "\n"),
        "drop_blank": lambda t: F.array_join(F.filter(F.split(t, "\n", -1), lambda x: F.length(F.trim(x)) > 0), "\n"),
        "sort_lines": lambda t: F.array_join(F.array_sort(F.split(t, "\n", -1)), "\n"),
        "drop_comments": lambda t: F.array_join(F.filter(F.split(t, "\n", -1), lambda x: ~F.ltrim(x).startswith("//")), "\n"),
    }
    for s in steps:
        text = made[s](text)
    return text


def operation_statistics(operations: DataFrame) -> DataFrame:
    """One row: completed, bytes, mean milliseconds, running, from (status, bytes, ms)."""
    return operations.agg(
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.sum("bytes").alias("bytes"),
        F.avg("ms").alias("mean_ms"),
        F.count_if(F.col("status") == "running").alias("running"),
    )


def time_estimate(bytes_: Column, per_second: int) -> Column:
    """Whole seconds."""
    return F.floor(bytes_ / F.lit(per_second)).cast("long")
