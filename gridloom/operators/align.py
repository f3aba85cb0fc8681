"""Joining cubes and series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.ranks import positions, value_chunk


def merge_vars(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Outer merge of two cubes on their coordinates."""
    return left.join(right, keys, "full_outer")


def pair_on_keys(truth: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """Truth and prediction side by side where both have a row."""
    return truth.join(pred, keys)


def with_grid_index(df: DataFrame, width: float = 1000.0) -> DataFrame:
    """Positions of a row on the y and x axis (1-based), as columns iy and ix."""
    out = df
    for axis in ("y", "x"):
        nodes = df.select(axis).distinct()
        ranked = positions(nodes, [], [axis], value_chunk(axis, width), f"i{axis}")
        out = out.join(ranked, [axis])
    return out


def pair_on_grid_index(
    truth: DataFrame, pred: DataFrame, keys: list[str], width: float = 1000.0
) -> DataFrame:
    """Pair by position on the grid; the truth's coordinates win."""
    t = with_grid_index(truth, width)
    p = with_grid_index(pred, width).drop("y", "x")
    return t.join(p, [*keys, "iy", "ix"]).drop("iy", "ix")


def three_way(truth: DataFrame, model: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Truth, model and reference on their common keys."""
    return truth.join(model, keys).join(reference, keys)


def merge_area_series(series: list[DataFrame], on: str = "time") -> DataFrame:
    """Inner merge of area-mean series."""
    out = series[0]
    for s in series[1:]:
        out = out.join(s, [on])
    return out


def stack_datasets(parts: list[DataFrame], index: str = "number") -> DataFrame:
    """Datasets of equal columns under one index, in the given order."""
    frames = [p.withColumn(index, F.lit(i)) for i, p in enumerate(parts)]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def area_mean(df: DataFrame, values: list[str], keys: list[str] | None = None) -> DataFrame:
    """Unweighted mean over the grid per time step."""
    return df.groupBy(*(keys or ["time"])).agg(*[F.avg(v).alias(v) for v in values])


def area_mean_weighted(
    df: DataFrame, values: list[str], weight: Column, keys: list[str] | None = None
) -> DataFrame:
    """Weighted mean over the cells that have a value."""
    return df.groupBy(*(keys or ["time"])).agg(
        *[
            F.try_divide(
                F.sum(weight * F.col(v)), F.sum(F.when(F.col(v).isNotNull(), weight))
            ).alias(v)
            for v in values
        ]
    )


def cos_latitude(latitude: Column) -> Column:
    return F.cos(F.radians(latitude))
