"""Resampling in time.

Daily results are dense: every cell has a row for every day between the first
and the last day of the data. The missing days come from a skeleton of
(cell, day) rows without a value that is appended before the one aggregation,
so no join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.ranks import attach, lead_rows, time_chunk


def day_skeleton(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Every cell on every day of the covered range."""
    span = df.agg(F.to_date(F.min(ts)).alias("lo"), F.to_date(F.max(ts)).alias("hi"))
    days = span.select(F.sequence("lo", "hi").alias("days")).scalar()
    return df.select(*keys).distinct().withColumn("time", F.explode(days))


def _daily(df: DataFrame, keys: list[str], ts: str, value: str, out: Column) -> DataFrame:
    rows = df.select(*keys, F.to_date(ts).alias("time"), F.col(ts).alias("_ts"), F.col(value).alias("_v"))
    kinds = dict(rows.dtypes)
    empty = day_skeleton(df, keys, ts).select(
        *keys,
        "time",
        F.lit(None).cast(kinds["_ts"]).alias("_ts"),
        F.lit(None).cast(kinds["_v"]).alias("_v"),
    )
    return rows.unionByName(empty).groupBy(*keys, "time").agg(out.alias(value))


def daily_mean(df: DataFrame, keys: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """Mean per day; a day without values is NULL."""
    return _daily(df, keys, ts, value, F.avg("_v"))


def daily_sum(
    df: DataFrame, keys: list[str], ts: str = "ts", value: str = "value", factor: float = 1000.0
) -> DataFrame:
    """Sum per day times a unit factor; a day without values is 0."""
    total = F.coalesce(F.sum("_v"), F.lit(0.0)) * F.lit(float(factor))
    return _daily(df, keys, ts, value, total)


def daily_max(df: DataFrame, keys: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    return _daily(df, keys, ts, value, F.max("_v"))


def daily_min(df: DataFrame, keys: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    return _daily(df, keys, ts, value, F.min("_v"))


def daily_first(df: DataFrame, keys: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """First non-missing value of the day."""
    when = F.when(F.col("_v").isNotNull(), F.col("_ts"))
    return _daily(df, keys, ts, value, F.min_by("_v", when))


def shift_then_daily(
    df: DataFrame,
    keys: list[str],
    how: str = "sum",
    steps: int = 6,
    ts: str = "ts",
    value: str = "value",
    factor: float = 1.0,
    unit: str = "hour",
) -> DataFrame:
    """Move each series `steps` rows back, aggregate by day, drop the last date."""
    moved = lead_rows(df.select(*keys, ts, value), keys, [ts], time_chunk(ts, unit), [value], steps)
    if how == "sum":
        daily = daily_sum(moved, keys, ts, value, factor)
    else:
        daily = daily_mean(moved, keys, ts, value)
    last = df.agg(F.to_date(F.max(ts)).alias("last")).scalar()
    return daily.filter(F.col("time") < last)


def daily_shift_one(
    df: DataFrame, keys: list[str], ts: str = "ts", value: str = "value"
) -> DataFrame:
    """Daily first value stamped one day earlier, last date dropped.

    The daily axis is dense, so moving by one row is moving by one day: the
    shift is a relabelling and needs no window.
    """
    first = df.agg(F.to_date(F.min(ts)).alias("first")).scalar()
    return (
        daily_first(df, keys, ts, value)
        .withColumn("time", F.date_sub("time", 1))
        .filter(F.col("time") >= first)
    )


def axis_counts(df: DataFrame, bucket: Column, name: str) -> DataFrame:
    """Number of distinct time steps of the cube in each calendar bucket."""
    return (
        df.select("time").distinct().groupBy(bucket.alias(name)).agg(F.count(F.lit(1)).alias("steps"))
    )


def monthly_sum(df: DataFrame, keys: list[str], values: list[str], skipna: bool = False) -> DataFrame:
    """Sum by month; without `skipna` one missing step makes the month missing.

    A step is missing when its value is NULL or when the cell has no row on a
    date of the cube's time axis.
    """
    month = F.trunc("time", "month")
    sums = df.groupBy(*keys, month.alias("month")).agg(
        *[F.sum(v).alias(v) for v in values], *[F.count(v).alias(f"_n_{v}") for v in values]
    )
    if skipna:
        return sums.select(*keys, "month", *[F.coalesce(v, F.lit(0.0)).alias(v) for v in values])
    whole = attach(sums, axis_counts(df, month, "month"), ["month"])
    return whole.select(
        *keys,
        "month",
        *[F.when(F.col(f"_n_{v}") == F.col("steps"), F.col(v)).alias(v) for v in values],
    )


def monthly_first(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """First non-missing value of each month."""
    when = F.when(F.col(value).isNotNull(), F.col("time"))
    return df.groupBy(*keys, F.trunc("time", "month").alias("month")).agg(
        F.min_by(value, when).alias(value)
    )


def leadtime_stitch(df: DataFrame, init: str = "init", lead_months: int = 1) -> DataFrame:
    """From each initialisation keep the calendar month `lead_months` after it."""
    target = F.pmod(F.month(init) + F.lit(lead_months - 1), F.lit(12)) + 1
    return df.filter(F.month("time") == target)
