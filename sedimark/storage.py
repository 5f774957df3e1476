"""Shared-folder storage: where jobs put what later jobs read.

Executors may be lost at any time and share no local disk, so every table that outlives a job is
written under the folder that the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session.

    ``spark.checkpoint.dir`` wins. Where it is unset and the master is local (tests), a temporary
    folder stands in; where it is unset on a cluster this raises, because no machine-local folder
    would be visible to all executors.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="sedimark-", dir="/tmp/checkpoints")
    return _OWN[app]


def new_path(spark: SparkSession, tag: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def staged(df: DataFrame, tag: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it as read from there.

    Cuts the lineage, survives lost executors, and keeps column pruning for whatever reads it next.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, ``<sf_dir>/<name>.parquet`` (a file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
