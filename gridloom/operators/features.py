"""Feature engineering and scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.calendar import day_angle
from gridloom.functions.numeric import ratio
from gridloom.operators.ranks import attach


def doy_encode(df: DataFrame, time: str = "time") -> DataFrame:
    """Sine and cosine of the day of year."""
    return df.withColumns({"doy_sin": F.sin(day_angle(time)), "doy_cos": F.cos(day_angle(time))})


def _bucket(by: str) -> Column:
    return {"month": F.month("time"), "dayofyear": F.dayofyear("time")}[by]


def anomaly(
    df: DataFrame, keys: list[str], values: list[str], by: str = "month", standard: bool = False
) -> DataFrame:
    """Departure from the mean of the same month or day of year, per cell.

    Group means are aggregated (partial sums, no whole group in one task) and
    joined back. `standard` divides by the population deviation; where that is
    zero the result is NULL.
    """
    rows = df.withColumn("_b", _bucket(by))
    stats = rows.groupBy(*keys, "_b").agg(
        *[F.avg(v).alias(f"_m_{v}") for v in values],
        *([F.stddev_pop(v).alias(f"_s_{v}") for v in values] if standard else []),
    )
    out = attach(rows, stats, [*keys, "_b"])
    for v in values:
        shifted = F.col(v) - F.col(f"_m_{v}")
        out = out.withColumn(v, ratio(shifted, f"_s_{v}") if standard else shifted)
    return out.select(*df.columns)


def minmax_period(
    df: DataFrame,
    values: list[str],
    period: tuple[str, str] | None = None,
    keys: list[str] | None = None,
) -> DataFrame:
    """Scale to [0, 1] with the extremes of a period; other dates may leave the range."""
    keys = keys or []
    base = df
    if period:
        base = df.filter(F.col("time").between(*[F.lit(p).cast("date") for p in period]))
    stats = base.groupBy(*keys).agg(
        *[F.min(v).alias(f"_lo_{v}") for v in values],
        *[(F.max(v) - F.min(v)).alias(f"_w_{v}") for v in values],
    )
    out = attach(df, stats, keys)
    return out.withColumns(
        {v: ratio(F.col(v) - F.col(f"_lo_{v}"), f"_w_{v}") for v in values}
    ).select(*df.columns)


def minmax_row(df: DataFrame, values: list[str], mode: str = "row") -> DataFrame:
    """Scale across the variables of a row (`row`) or each variable over all rows (`column`)."""
    if mode == "column":
        return minmax_column(df, values)
    whole = F.lit(True)
    for v in values:
        whole = whole & F.col(v).isNotNull()
    lo, hi = F.least(*values), F.greatest(*values)
    return df.withColumns({v: F.when(whole, ratio(F.col(v) - lo, hi - lo)) for v in values})


def minmax_column(df: DataFrame, values: list[str], factor: float = 1.0) -> DataFrame:
    """Scale each column to [0, factor] over all rows."""
    scaled = minmax_period(df, values)
    if factor == 1.0:
        return scaled
    return scaled.withColumns({v: F.col(v) * F.lit(float(factor)) for v in values})


def zscore(
    df: DataFrame, values: list[str], sample: bool = True, keys: list[str] | None = None
) -> DataFrame:
    """Mean 0, deviation 1 over all rows; sample (n - 1) or population deviation."""
    keys = keys or []
    deviation = F.stddev_samp if sample else F.stddev_pop
    stats = df.groupBy(*keys).agg(
        *[F.avg(v).alias(f"_m_{v}") for v in values],
        *[deviation(v).alias(f"_s_{v}") for v in values],
    )
    out = attach(df, stats, keys)
    return out.withColumns(
        {v: ratio(F.col(v) - F.col(f"_m_{v}"), f"_s_{v}") for v in values}
    ).select(*df.columns)


def unit_convert(df: DataFrame, conversions: dict[str, Column]) -> DataFrame:
    """Replace columns by converted values."""
    return df.withColumns(conversions)


def valid_cells(df: DataFrame, keys: list[str], needed: list[str]) -> DataFrame:
    """Drop every cell in which any needed value is missing."""
    gap = F.lit(False)
    for v in needed:
        gap = gap | F.col(v).isNull()
    bad = df.filter(gap).select(*keys).distinct()
    return df.join(bad, keys, "left_anti")


def mask_by_truth(df: DataFrame, truth: str, values: list[str]) -> DataFrame:
    """Values become missing where the truth is missing."""
    return df.withColumns({v: F.when(F.col(truth).isNotNull(), F.col(v)) for v in values})


def fill_sentinel(df: DataFrame, values: list[str], sentinel: float = 9999.0) -> DataFrame:
    """Missing values become a sentinel; mask the result afterwards with mask_by_truth."""
    return df.fillna(sentinel, subset=values)


def melt_features(df: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    """One row per feature."""
    return df.unpivot(ids, features, "feature", "value")


def cell_series(df: DataFrame, values: list[str]) -> DataFrame:
    """Time-ordered feature matrix of every cell, one row per cell and year.

    A year bounds the array: a cell's whole series never sits in one row.
    """
    return (
        df.groupBy("y", "x", F.year("time").alias("year"))
        .agg(F.sort_array(F.collect_list(F.struct("time", *values))).alias("series"))
    )
