"""Numeric expressions: missing values, ratios, units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a, b) -> Column:
    """a / b, NULL where b is zero."""
    return F.try_divide(col(a), col(b))


def relative_bias(pred, truth) -> Column:
    """Difference in percent of the truth, NULL where the truth is zero."""
    return F.lit(100.0) * ratio(col(pred) - col(truth), truth)


def both(a, b) -> Column:
    """True where neither value is missing."""
    return col(a).isNotNull() & col(b).isNotNull()


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating point column (done once, at the source)."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        *[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns]
    )


def kelvin_to_celsius(c) -> Column:
    return col(c) - F.lit(273.15)


def metres_to_millimetres(c) -> Column:
    return col(c) * F.lit(1000.0)


def flux_to_step_millimetres(c, steps: int = 6) -> Column:
    """Metres accumulated over `steps` steps to millimetres per step."""
    return col(c) * F.lit(1000.0) / F.lit(float(steps))


def r2(truth, pred) -> Column:
    """Aggregate: coefficient of determination over pairs with both values.

    One pass: the total sum of squares comes from the merged population
    variance. A constant truth scores 1 when matched exactly and 0 otherwise;
    fewer than one pair gives NULL.
    """
    ok = both(truth, pred)
    t, p = F.when(ok, col(truth)), F.when(ok, col(pred))
    residual = F.sum((t - p) * (t - p))
    total = F.var_pop(t) * F.count(t)
    return (
        F.when(F.count(t) == 0, F.lit(None).cast("double"))
        .when(total == 0, F.when(residual == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
        .otherwise(F.lit(1.0) - F.try_divide(residual, total))
    )


def rmse(truth, pred) -> Column:
    """Aggregate: root mean squared error."""
    d = col(pred) - col(truth)
    return F.sqrt(F.avg(d * d))


def mae(truth, pred) -> Column:
    """Aggregate: mean absolute error."""
    return F.avg(F.abs(col(pred) - col(truth)))


def bias(truth, pred) -> Column:
    """Aggregate: mean difference prediction - truth."""
    return F.avg(col(pred) - col(truth))
