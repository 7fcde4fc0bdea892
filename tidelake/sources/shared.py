"""Folders that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def top(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; in local mode without that setting one in /tmp."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "/tmp/checkpoints"


def hadoop(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call gets; what is written there goes when the application ends."""
    path = f"{top(spark)}/{name}-{uuid.uuid4().hex}"
    fs, p = hadoop(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path
