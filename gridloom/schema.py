"""Table shapes and closed vocabularies.

A cube is a long DataFrame with one row per (time, y, x) or per
(time, y, x, member); every variable is one column, missing values are NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

CELL = ["y", "x"]
CUBE = ["time", "y", "x"]
ENSEMBLE = ["time", "y", "x", "member"]

# Predictor names and their short column names.
PRESSURE_VARIABLES = {
    "geopotential": "z",
    "temperature": "t",
    "u_component_of_wind": "u",
    "v_component_of_wind": "v",
    "specific_humidity": "q",
}
SURFACE_VARIABLES = {
    "mean_sea_level_pressure": "mslp",
    "2m_temperature": "t2m",
    "total_precipitation": "pr",
    "surface_pressure": "p",
    "2m_dewpoint_temperature": "t2d",
}
# Variables that can be predicted, learners known by name.
PREDICTANDS = ("tasmin", "tasmax", "pr", "tasmean")
LEARNERS = ("RandomForestRegressor", "XGBRegressor", "AdaBoostRegressor", "LGBMRegressor")


def cube_schema(variables: list[str], member: bool = False) -> T.StructType:
    """Schema of a daily cube holding the given value columns."""
    fields = [
        T.StructField("time", T.DateType(), False),
        T.StructField("y", T.DoubleType(), False),
        T.StructField("x", T.DoubleType(), False),
    ]
    if member:
        fields.append(T.StructField("member", T.IntegerType(), False))
    return T.StructType(fields + [T.StructField(v, T.DoubleType()) for v in variables])


def check_vocabulary(names: list[str], allowed, what: str) -> None:
    """Raise on a name outside a closed vocabulary."""
    unknown = sorted(set(names) - set(allowed))
    if unknown:
        raise ValueError(f"unknown {what}: {unknown}; allowed: {sorted(allowed)}")


def check_columns(df: DataFrame, needed: list[str]) -> None:
    """Raise when a frame lacks a column an operator needs."""
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; frame has {df.columns}")
