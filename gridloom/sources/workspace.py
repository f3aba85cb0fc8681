"""Shared folder for written tables and checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Where it is unset, a local session (one machine, as in tests) gets a folder of its own; on a
    cluster that would lose data, so there it is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="run-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint: the result outlives lost executors and long lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager)


def stored(df: DataFrame, label: str = "table") -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts lineage like a checkpoint; besides, the planner then knows the
    table's size, so it broadcasts it only where it is small.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete the files of a `stored` table that a loop has superseded."""
    spark = table.sparkSession
    shared = shared_folder(spark).rstrip("/").removeprefix("file://")
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if shared in folder:  # nothing outside the work folder
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
