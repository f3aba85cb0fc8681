"""Aggregation by calendar and space.

Exact `percentile` is used only inside groups bounded by the calendar (one
cell's year, season or series); pooled groups use the skew-safe quantiles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.calendar import season
from gridloom.operators.ranks import attach, quantile_columns
from gridloom.sources.workspace import stored

CELL = ["y", "x"]


def _means(values: list[str]) -> list[Column]:
    return [F.avg(v).alias(v) for v in values]


def month_climatology(df: DataFrame, values: list[str], keys: list[str] = CELL) -> DataFrame:
    """Mean by calendar month per cell."""
    return df.groupBy(*keys, F.month("time").alias("month")).agg(*_means(values))


def annual_cycle(df: DataFrame, values: list[str], pooled: bool = False) -> DataFrame:
    """Area mean per calendar month: of cell means, or pooled over all rows."""
    if pooled:
        return df.groupBy(F.month("time").alias("month")).agg(*_means(values))
    return month_climatology(df, values).groupBy("month").agg(*_means(values))


def year_mean(df: DataFrame, values: list[str], keys: list[str] = CELL) -> DataFrame:
    return df.groupBy(*keys, F.year("time").alias("year")).agg(*_means(values))


def season_mean(df: DataFrame, values: list[str], keys: list[str] = CELL) -> DataFrame:
    """Mean by season over all years; December counts to its own year's winter."""
    return df.groupBy(*keys, season("time").alias("season")).agg(*_means(values))


def year_quantile(df: DataFrame, values: list[str], q: float, keys: list[str] = CELL) -> DataFrame:
    """Interpolated quantile of each cell's year."""
    return df.groupBy(*keys, F.year("time").alias("year")).agg(
        *[F.percentile(v, q).alias(v) for v in values]
    )


def season_quantile(df: DataFrame, values: list[str], q: float, keys: list[str] = CELL) -> DataFrame:
    """Interpolated quantile of each cell's season over all years."""
    return df.groupBy(*keys, season("time").alias("season")).agg(
        *[F.percentile(v, q).alias(v) for v in values]
    )


def time_mean(df: DataFrame, values: list[str], keys: list[str] = CELL) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(v).alias(f"{v}_mean") for v in values])


def time_std(df: DataFrame, values: list[str], keys: list[str] = CELL) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.stddev_pop(v).alias(f"{v}_std") for v in values])


def time_median(df: DataFrame, values: list[str], keys: list[str] = CELL) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.median(v).alias(f"{v}_median") for v in values])


def time_quantile_features(
    df: DataFrame, values: list[str], probs: tuple[float, ...] = (0.1, 0.9), keys: list[str] = CELL
) -> DataFrame:
    """Quantiles over time as features of a cell."""
    return df.groupBy(*keys).agg(
        *[F.percentile(v, p).alias(f"{v}_{round(p * 100)}") for v in values for p in probs]
    )


def global_summary(df: DataFrame, values: list[str]) -> DataFrame:
    """Mean, deviation, extremes and median of each column over all rows."""
    long = df.unpivot([], values, "dataset", "value")
    stats = long.groupBy("dataset").agg(
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    medians = quantile_columns(long, ["dataset"], "value", {"median": 0.5})
    return stats.join(medians, ["dataset"], "left")


def time_range(df: DataFrame) -> DataFrame:
    return df.agg(F.year(F.min("time")).alias("first_year"), F.year(F.max("time")).alias("last_year"))


def correlation_matrix(df: DataFrame, features: list[str]) -> DataFrame:
    """Pearson correlation of every pair below the diagonal, over the rows that have both; NaN counts as missing.

    A batch of rows becomes four masked matrix products, added up inside a task, so a task sends one row per pair
    whatever it has read. Values are shifted by their mean (by the value itself in a constant column), taken in a
    scan before, which keeps the sums well conditioned. An empty table gives no rows, a pair without spread NULL.
    """
    values = df.select(*[F.nanvl(F.col(f).cast("double"), F.lit(None)).alias(f) for f in features])
    shift = _middles(values)

    def products(batches):
        total = None
        for batch in batches:
            x = _matrix(batch) - np.array(shift)
            there = ~np.isnan(x)
            x, there = np.where(there, x, 0.0), there.astype(float)
            new = np.stack([there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x])
            total = new if total is None else total + new
        if total is not None:
            i, j = np.tril_indices(len(shift), -1)
            n, s, q, p = total
            columns = [n[i, j], s[i, j], s[j, i], q[i, j], q[j, i], p[i, j]]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *map(pa.array, columns)], ["i", "j", *sums])

    sums = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    parts = values.mapInArrow(products, "i int, j int, " + ", ".join(f"{c} double" for c in sums))
    pairs = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in sums])
    var_x, var_y = (F.col(f"s{c}{c}") - F.col(f"s{c}") * F.col(f"s{c}") / F.col("n") for c in "xy")
    varied = (F.col("n") > 0) & (var_x > F.col("sxx") * 1e-13) & (var_y > F.col("syy") * 1e-13)  # more than rounding
    r = F.when(varied, (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(var_x * var_y))
    names = F.array(*[F.lit(f) for f in features])
    return pairs.select(F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), r.alias("r"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])


def _middles(values: DataFrame) -> list[float]:
    """Mean of every column, a constant column's value itself, 0 where all is missing. A task sends one row per column."""

    def ends(batches):
        n, total = 0, 0.0
        low, high = np.inf, -np.inf
        for x in map(_matrix, batches):
            n, total = n + (~np.isnan(x)).sum(0), total + np.nansum(x, 0)
            low, high = np.fmin(low, np.fmin.reduce(x, 0, initial=np.inf)), np.fmax(high, np.fmax.reduce(x, 0, initial=-np.inf))
        if np.ndim(n):
            columns = [np.arange(len(n)), n.astype(float), total, low, high]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["i", "n", "total", "low", "high"])

    parts = values.mapInArrow(ends, "i long, n double, total double, low double, high double")
    merged = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))
    middle = F.when(F.col("n") == 0, 0.0).when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("total") / F.col("n"))
    found = {row.i: row.middle for row in merged.select("i", middle.alias("middle")).collect()}
    return [found.get(i, 0.0) for i in range(len(values.columns))]


def box_stats(df: DataFrame, keys: list[str], value: str, reach: float = 1.5) -> DataFrame:
    """Quartiles, whiskers at the last value within `reach` box lengths, outlier count."""
    quartiles = stored(quantile_columns(df, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}))
    rows = attach(df.filter(F.col(value).isNotNull()).select(*keys, value), quartiles, keys)
    box = F.col("q3") - F.col("q1")
    inside = F.col(value).between(F.col("q1") - reach * box, F.col("q3") + reach * box)
    return rows.groupBy(*keys, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
        F.count(F.lit(1)).alias("n"),
    )
