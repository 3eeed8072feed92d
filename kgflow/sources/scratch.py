"""Scratch space that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new folder below spark.checkpoint.dir.  Where that is unset, local mode takes a temporary folder for the session;
    a cluster has no folder that is known to be shared, so that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        local = master.startswith("local") and "cluster" not in master
        if not local:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-kgflow-")
        spark.conf.set("spark.checkpoint.dir", root)  # one folder a session
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, tag: str) -> DataFrame:
    """The rows of df as a Parquet table in scratch space: cuts lineage and survives lost executors.

    The shuffle files that the write needed go when it is done, since nothing reads them again.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, tag), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
