"""Versions of tables: transactions by staged write and swap, backups with restore and expiry, cut-offs by time.

A versioned table is a folder with one sub-folder of Parquet files per version and a log of which version is current.
A version is written whole before its log entry is, so readers see the old one or the new one, and an action that fails
leaves the old one current.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def create(table: DataFrame, folder: str) -> None:
    """Begin a versioned table in ``folder``; raises where there is one."""
    if not _commit(table, folder, 0):
        raise FileExistsError(folder)


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    """(entry, version) of the log: one file an entry, whose name is the entry and whose line is the version."""
    entry = F.regexp_extract("_metadata.file_name", r"([0-9]+)\.entry$", 1).cast("long")
    return spark.read.text(f"{folder}/log").select(entry.alias("entry"), F.col("value").alias("version"))


def _commit(table: DataFrame, folder: str, entry: int) -> bool:
    """Write a version, then its log entry if no other writer has taken that number: the file system creates a file only once."""
    spark, version = table.sparkSession, uuid.uuid4().hex
    table.write.parquet(f"{folder}/{version}")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/log/{entry:012d}.entry")
    try:
        out = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(path, False)
    except Exception as error:
        if "AlreadyExists" in str(error):
            return False
        raise
    out.writeBytes(version + "\n")
    out.close()
    return True


def current(spark: SparkSession, folder: str, entry: int | None = None) -> DataFrame:
    """The table as of log entry ``entry``, the last one if none is given."""
    log = _entries(spark, folder)
    log = log.filter(F.col("entry") <= entry) if entry is not None else log
    version = log.agg(F.max_by("version", "entry")).collect()[0][0]
    return spark.read.parquet(f"{folder}/{version}")


def transaction(spark: SparkSession, folder: str, action: Callable[[DataFrame], DataFrame], attempts: int = 10) -> int:
    """Make ``action`` of the current version the next one; returns its log entry. Nothing changes where it raises.

    Where another writer commits first, ``action`` is done again on what that one left.
    """
    for _ in range(attempts):
        last = _entries(spark, folder).agg(F.max("entry")).collect()[0][0]
        if _commit(action(current(spark, folder, last)), folder, last + 1):
            return last + 1
    raise RuntimeError("other writers were first every time")


def backup(files: DataFrame, made_at: Column) -> DataFrame:
    """(path, text, digest, made_at) of files (path, text)."""
    return files.select("path", "text", F.sha2("text", 256).alias("digest"), made_at.alias("made_at"))


def restore(files: DataFrame, saved: DataFrame) -> DataFrame:
    """(path, text, restored): the saved text where the file differs from it or is gone; other files as they are.

    Raises where a saved text does not have its digest any more.
    """
    broken = F.raise_error(F.concat(F.lit("backup is damaged: "), F.col("path")))
    then = F.when(F.sha2("then", 256) == F.col("digest"), F.col("then")).otherwise(broken.cast("string"))
    met = files.select("path", "text").join(saved.select("path", F.col("text").alias("then"), "digest"), "path", "full_outer")
    changed = F.col("digest").isNotNull() & (F.col("text").isNull() | (F.sha2("text", 256) != F.col("digest")))
    return met.select("path", F.when(changed, then).otherwise(F.col("text")).alias("text"), changed.alias("restored"))


def unexpired(saved: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Backups that are at most ``days`` old."""
    return saved.filter(F.col("made_at") >= now - F.make_dt_interval(F.lit(days)))


def newest(operations: DataFrame, at: str, tie: str, k: int = 50) -> DataFrame:
    """The ``k`` latest operations, the newest first."""
    return operations.orderBy(F.desc(at), tie).limit(k)
