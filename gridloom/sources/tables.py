"""Adapters that shape the driver's relational tables like climate cubes.

Sums run over whole hundredths in 64-bit integers, so the cubes carry the
same doubles whatever the order of the rows. SCALE is close to 100 and has a
large prime factor: means of cube values then never end on a half digit, so
comparing results at six decimals is free of rounding ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE = 99.991


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _hundredths(c: Column) -> Column:
    return F.round(c * 100).cast("bigint")


def _mean(c: Column, scale: float) -> Column:
    return F.sum(_hundredths(c)).cast("double") / (F.count(F.lit(1)) * F.lit(scale))


def _period(df: DataFrame, column: str, start: str | None, end: str | None) -> DataFrame:
    """Limit on the raw column, so that it reaches the file scan."""
    if start:
        df = df.filter(F.col(column) >= F.lit(start).cast("timestamp_ntz"))
    if end:
        df = df.filter(F.col(column) < F.lit(end).cast("timestamp_ntz"))
    return df


def pair(spark: SparkSession, sf: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Daily truth / prediction / reference cube on a 5 x 5 grid (end exclusive)."""
    lines = _period(read(spark, sf, "lineitem"), "l_shipdate", start, end)
    factor = 1 + F.col("l_discount") - F.col("l_tax")
    hidden = (F.dayofyear("time") + 3 * F.col("y") + F.col("x")) % 17 == 0
    return (
        lines.groupBy(
            F.to_date("l_shipdate").alias("time"),
            (F.col("l_suppkey") % 5).cast("int").alias("y"),
            (F.col("l_partkey") % 5).cast("int").alias("x"),
        )
        .agg(
            _mean(F.col("l_quantity"), SCALE).alias("truth"),
            _mean(F.col("l_extendedprice"), 2100 * SCALE).alias("pred"),
            _mean(F.col("l_quantity") * factor, SCALE).alias("refe"),
        )
        .withColumn("truth", F.when(~hidden, F.col("truth")))
    )


def rain(spark: SparkSession, sf: str, **period) -> DataFrame:
    """The pair cube turned rain-like: many zeros, no negative value."""
    return as_rain(pair(spark, sf, **period))


def as_rain(cube: DataFrame) -> DataFrame:
    """Values above 25, as the excess over it; zero below."""
    cut = {
        v: F.when(F.col(v).isNotNull(), F.greatest(F.col(v) - 25, F.lit(0.0)))
        for v in ("truth", "pred", "refe")
    }
    return cube.withColumns(cut)


def booked(spark: SparkSession, sf: str) -> DataFrame:
    """A second daily product on the same grid, from another table."""
    return (
        read(spark, sf, "orders")
        .groupBy(
            F.to_date("o_orderdate").alias("time"),
            (F.col("o_custkey") % 5).cast("int").alias("y"),
            (F.col("o_orderkey") % 5).cast("int").alias("x"),
        )
        .agg(_mean(F.col("o_totalprice"), 7000 * SCALE).alias("model"))
    )


def ens(spark: SparkSession, sf: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Monthly ensemble of up to seven members on the same grid."""
    lines = _period(read(spark, sf, "lineitem"), "l_shipdate", start, end)
    return lines.groupBy(
        F.trunc(F.to_date("l_shipdate"), "month").alias("time"),
        (F.col("l_suppkey") % 5).cast("int").alias("y"),
        (F.col("l_partkey") % 5).cast("int").alias("x"),
        F.col("l_linenumber").alias("member"),
    ).agg(_mean(F.col("l_extendedprice"), 2100 * SCALE).alias("pred"))


def monthly_truth(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly mean of the daily truth: the observation of the ensemble."""
    return (
        pair(spark, sf)
        .groupBy(F.trunc("time", "month").alias("time"), "y", "x")
        .agg(F.avg("truth").alias("truth"))
    )


def sub(spark: SparkSession, sf: str) -> DataFrame:
    """Sub-daily series of 10 cells and 5 variables; each variable stands on one level."""
    level = (
        F.when(F.col("event_type") == "click", 250)
        .when(F.col("event_type") == "view", 500)
        .when(F.col("event_type") == "purchase", 850)
        .when(F.col("event_type") == "signup", 925)
        .otherwise(1000)
    )
    return read(spark, sf, "events").select(
        "ts",
        (F.col("user_id") % 10).cast("int").alias("x"),
        F.col("event_type").alias("variable"),
        level.alias("level"),
        (F.col("value") / F.lit(SCALE / 100)).alias("value"),
    )


def dem(spark: SparkSession, sf: str) -> DataFrame:
    """Dense elevation raster, 20 columns wide."""
    return read(spark, sf, "part").select(
        F.floor(F.col("p_partkey") / 20).cast("int").alias("y"),
        (F.col("p_partkey") % 20).cast("int").alias("x"),
        F.col("p_retailprice").alias("elevation"),
    )


def lead(spark: SparkSession, sf: str) -> DataFrame:
    """Forecast values with the month they were started in."""
    day = F.to_date("o_orderdate")
    months = (F.col("o_custkey") % 7).cast("int")
    return read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        day.alias("time"),
        (F.col("o_custkey") % 5).cast("int").alias("x"),
        F.add_months(F.trunc(day, "month"), -months).alias("init"),
        F.col("o_totalprice").alias("value"),
    )


FEATURES = [f"f{i}" for i in range(64)]


def emb(spark: SparkSession, sf: str) -> DataFrame:
    """Feature matrix: all entries of every embedding."""
    return read(spark, sf, "embeddings").select(
        "vec_id",
        "label",
        *[
            F.element_at("embedding", i + 1).cast("double").alias(name)
            for i, name in enumerate(FEATURES)
        ],
    )
