"""Selecting variables, levels, periods and parts of the grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.schema import check_columns


def select_vars(df: DataFrame, keys: list[str], known: list[str]) -> DataFrame:
    """Keep the key columns and those known variables that the frame has."""
    check_columns(df, keys)
    return df.select(*keys, *[v for v in known if v in df.columns])


def level_pivot(
    df: DataFrame, keys: list[str], variables: list[str], levels: list[int], level: str = "level"
) -> DataFrame:
    """One column `<variable>_<level>` per variable and wanted level.

    The level filter sits below the aggregation, so it reaches the scan; a
    level without data leaves its column NULL.
    """
    cells = [
        F.max(F.when(F.col(level) == lev, F.col(v))).alias(f"{v}_{lev}")
        for v in variables
        for lev in levels
    ]
    return df.filter(F.col(level).isin(levels)).groupBy(*keys).agg(*cells)


def level_concat(parts: dict[int, DataFrame], level: str = "level") -> DataFrame:
    """Stack single-level cubes under a level column."""
    frames = [df.withColumn(level, F.lit(lev).cast("int")) for lev, df in parts.items()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


# Coordinate names met in source files and their common names.
COORDINATES = {
    "longitude": "x",
    "lon": "x",
    "latitude": "y",
    "lat": "y",
    "valid_time": "time",
    "number": "member",
    "isobaricInhPa": "level",
}


def canonicalize(
    df: DataFrame, variables: dict[str, str], renames: dict[str, str] | None = None
) -> DataFrame:
    """Common coordinate names, types and column order; extra columns are dropped.

    `variables` maps each wanted source variable to its output name.
    """
    out = df.withColumnsRenamed({**COORDINATES, **(renames or {})})
    kinds = {"time": "date", "level": "int", "member": "int", "y": "double", "x": "double"}
    keys = [F.col(k).cast(t).alias(k) for k, t in kinds.items() if k in out.columns]
    values = [F.col(s).cast("double").alias(n) for s, n in variables.items()]
    return out.select(*keys, *values)


def bbox_clip(df: DataFrame, y: tuple[float, float], x: tuple[float, float]) -> DataFrame:
    """Cells inside a latitude / longitude box, both ends included."""
    return df.filter(F.col("y").between(*y) & F.col("x").between(*x))


def first_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n smallest distinct values of an axis (a distributed top-n)."""
    return df.select(column).distinct().orderBy(column).limit(n)


def index_window(df: DataFrame, rows: int, columns: int) -> DataFrame:
    """The first rows x columns of the grid by position on the axes."""
    kept = df.join(first_values(df, "y", rows), ["y"], "left_semi")
    return kept.join(first_values(df, "x", columns), ["x"], "left_semi")


def time_slice(df: DataFrame, start: str, end: str) -> DataFrame:
    """A period, both ends included."""
    return df.filter(F.col("time").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def first_n_steps(df: DataFrame, n: int) -> DataFrame:
    """The first n time steps of the cube."""
    return df.join(first_values(df, "time", n), ["time"], "left_semi")


def match_keys(df: DataFrame, other: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """Rows of `df` whose keys occur in `other`; `strict` raises if a key is absent here."""
    wanted = other.select(*keys).distinct()
    if strict:
        absent = wanted.join(df.select(*keys).distinct(), keys, "left_anti").limit(1)
        if not absent.isEmpty():
            raise KeyError(f"not every {keys} of the other cube is present")
    return df.join(wanted, keys, "left_semi")


def match_time(df: DataFrame, other: DataFrame, strict: bool = False) -> DataFrame:
    """Truth on the dates of a prediction."""
    return match_keys(df, other, ["time"], strict)


def match_cells(df: DataFrame, other: DataFrame, strict: bool = False) -> DataFrame:
    """Truth on the grid cells of a prediction."""
    return match_keys(df, other, ["y", "x"], strict)
