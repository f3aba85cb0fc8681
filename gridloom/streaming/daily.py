"""Incremental daily aggregation of arriving sub-daily files.

A yearly pre-processing run skips what is already done; here a stream's
checkpoint remembers the files read. Only days that can no longer change are
written, each exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def read_arrivals(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """Stream of the rows of new Parquet files in a folder; `ts` must be a timestamp."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def daily_stream(arrivals: DataFrame, keys: list[str], value: str, how: str = "mean", delay: str = "1 day") -> DataFrame:
    """Daily mean, sum, max or min per key; a day closes `delay` after its end."""
    out = {
        "mean": F.avg(value),
        "sum": F.coalesce(F.sum(value), F.lit(0.0)),
        "max": F.max(value),
        "min": F.min(value),
    }[how]
    days = F.window("ts", "1 day")
    return (
        arrivals.withWatermark("ts", delay)
        .groupBy(*keys, days.alias("_day"))
        .agg(out.alias(value))
        .select(F.to_date("_day.start").alias("time"), *keys, value)
    )


def append_days(days: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process everything that has arrived, append the closed days, stop."""
    return (
        days.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
