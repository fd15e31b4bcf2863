"""Session helpers: the shared scratch folder and durable lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session without
    that setting (tests) gets a temporary folder of its own; a cluster without
    it is an error, as executors would not see each other's files.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir()
    if folder is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-"))
        folder = sc.getCheckpointDir()
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for a table written on the way."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def freeze(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint that outlives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back (columnar, prunable)."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """File system of a path as Spark writes it, and the path in it."""
    local = re.sub("^file:/+", "/", path)
    return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(path)
