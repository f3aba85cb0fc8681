"""Cubes published as whole snapshots: a reader sees the old run or the new one, never a part."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources.files import exists


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    if not exists(spark, folder):
        return []
    path, system = _path(spark, folder)
    return sorted(s.getPath().getName() for s in system.listStatus(path))


def versions(spark: SparkSession, path: str, run_key: str) -> list[str]:
    """Published versions of a run, oldest first; each is named by its number and its snapshot folder."""
    return [n for n in _names(spark, f"{path}/current/{run_key}") if not n.startswith((".", "_"))]


def publish_cube(df: DataFrame, path: str, run_key: str, by: tuple[str, ...] = ("year",), overwrite: bool = False) -> bool:
    """Write a run into a folder of its own and then make it the current one; False if it is there and `overwrite` is off.

    The rows go to `snapshots/<run>/<id>`. Only after all of them are committed does an empty file
    `current/<run>/<number>.<id>` name that folder, and creating a file is one step on any file system. A
    run that is killed before leaves the former version as it was. Two writers at a time both keep whole
    snapshots; readers take the greatest name. A run without rows is published as such.
    """
    spark = df.sparkSession
    known = versions(spark, path, run_key)
    if known and not overwrite:
        return False
    name = uuid.uuid4().hex
    target = f"{path}/snapshots/{run_key}/{name}"
    df.withColumn("year", F.year("time")).hint("rebalance", *by).write.partitionBy(*by).option("compression", "zstd").parquet(target)
    number = int(known[-1].split(".")[0]) + 1 if known else 1
    entry, system = _path(spark, f"{path}/current/{run_key}/{number:010d}.{name}")
    if not system.createNewFile(entry):
        raise FileExistsError(str(entry))
    return True


def read_published(spark: SparkSession, path: str, run_keys: list[str] | None = None, version: int | None = None) -> DataFrame:
    """The current version (or a numbered one that is still kept) of the named runs, all by default, with `run_key`."""
    parts = []
    for run_key in run_keys if run_keys is not None else _names(spark, f"{path}/current"):
        known = [v for v in versions(spark, path, run_key) if version is None or int(v.split(".")[0]) == version]
        if not known:
            raise FileNotFoundError(f"{path}: no version of {run_key}")
        folder = f"{path}/snapshots/{run_key}/{known[-1].split('.')[1]}"
        parts.append(spark.read.parquet(folder).withColumn("run_key", F.lit(run_key)))
    if not parts:
        raise FileNotFoundError(f"{path}: nothing published")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def prune(spark: SparkSession, path: str, run_key: str, keep: int = 2) -> int:
    """Delete all versions but the last `keep`: first the name, then the folder. Unnamed folders may be runs under way and stay."""
    old = versions(spark, path, run_key)[: -max(1, keep)]
    for name in old:
        for folder in (f"{path}/current/{run_key}/{name}", f"{path}/snapshots/{run_key}/{name.split('.')[1]}"):
            entry, system = _path(spark, folder)
            system.delete(entry, True)
    return len(old)
