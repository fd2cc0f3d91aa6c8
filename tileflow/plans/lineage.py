"""Cutting lineage in loops, and folders that every machine sees: both below the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_base(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, one of our own, which only a local master may have."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: a cluster has to name a folder that all its machines see")
        base = "file://" + tempfile.mkdtemp(prefix="tileflow-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in that folder."""
    return f"{shared_base(spark).rstrip('/')}/tileflow/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the checkpoint folder, dealt and sorted as it was."""
    shared_base(df.sparkSession)
    return df.checkpoint()


def drop(df: DataFrame) -> None:
    """Delete what cut() has kept, once nothing reads it any more."""
    kept = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if kept.isDefined():
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(kept.get())
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
