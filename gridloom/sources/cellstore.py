"""Cell-major store: a cube bucketed by cell and sorted by time, so that work per cell needs no exchange.

A cell is in one bucket, hence in one task: its rows are bounded by the time axis and the members. Fits,
predictions and anomalies of the store are planned without moving the cube; only `write_store` shuffles it, once.

The buckets go by `cell`, the coordinates as one text: the planner normalises doubles before it groups or joins
by them, and then no longer knows that the buckets fit.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridloom.functions.numeric import ratio
from gridloom.operators import linear
from gridloom.schema import CELL
from gridloom.sources.snapshots import _names

FOLDER = "cells_by_"  # the folder's name keeps the number of buckets
KEY = "cell"


def cell_key() -> Column:
    """y and x as one text; -0.0 is 0.0, a missing coordinate is empty."""
    plain = [F.coalesce((F.col(c) + F.lit(0)).cast("string"), F.lit("")) for c in CELL]
    return F.concat(plain[0], F.lit(" "), plain[1])


def bucket_count(df: DataFrame, bucket_rows: int = 4_000_000) -> int:
    """Buckets of about `bucket_rows` rows, but not more than there are cells."""
    size = df.groupBy(*CELL).count().agg(F.sum("count").alias("rows"), F.count(F.lit(1)).alias("cells")).first()
    return max(1, min(size["cells"], -(-(size["rows"] or 0) // bucket_rows)))


def write_store(df: DataFrame, path: str, buckets: int, order: str = "time") -> DataFrame:
    """Write a cube, with its `cell`, as one sorted file per bucket and open it; an existing store raises."""
    spark = df.sparkSession
    if _stores(spark, path):
        raise FileExistsError(path)
    (
        df.withColumn(KEY, cell_key())
        .repartition(buckets, KEY)
        .write.format("parquet")
        .bucketBy(buckets, KEY)
        .sortBy(KEY, order)
        .option("path", f"{path}/{FOLDER}{buckets}")
        .option("compression", "zstd")
        .saveAsTable(_table())
    )
    return open_store(spark, path, order)


def open_store(spark: SparkSession, path: str, order: str = "time") -> DataFrame:
    """The store at `path`, also when another session wrote it."""
    found = _stores(spark, path)
    if not found:
        raise FileNotFoundError(path)
    buckets, table, folder = int(found[0].removeprefix(FOLDER)), _table(), f"{path}/{found[0]}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(folder).schema)
    spark.sql(
        f"create table {table} ({columns}) using parquet location '{folder}'"
        f" clustered by ({KEY}) sorted by ({KEY}, {order}) into {buckets} buckets"
    )
    return spark.table(table)


def _stores(spark: SparkSession, path: str) -> list[str]:
    return [n for n in _names(spark, path) if n.startswith(FOLDER)]


def _table() -> str:
    return f"cells_{uuid.uuid4().hex}"


def store_anomaly(store: DataFrame, values: list[str], bucket: str = "month", standard: bool = False) -> DataFrame:
    """Departure from the cell's mean of the same month (or dayofyear), by windows inside the buckets.

    A window holds one cell's rows of a calendar bucket. `standard` divides by the population deviation;
    where that is zero the result is NULL.
    """
    same = W.partitionBy(KEY, getattr(F, bucket)("time"))
    out = {}
    for v in values:
        shifted = F.col(v) - F.avg(v).over(same)
        out[v] = ratio(shifted, F.stddev_pop(v).over(same)) if standard else shifted
    return store.select(*[out[c].alias(c) if c in out else F.col(c) for c in store.columns])


def store_fit_predict(store: DataFrame, feature: str, target: str, split: str) -> DataFrame:
    """A line per cell from the rows before `split`, applied to the later ones; both sides keep the buckets."""
    day = F.lit(split).cast("date")
    model = linear.fit_cell_linear(store.filter(F.col("time") < day), [KEY], feature, target)
    return linear.predict_linear(store.filter(F.col("time") >= day), model, [KEY], feature, "predicted")
