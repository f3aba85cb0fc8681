"""Calendar expressions on date columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Season names in meteorological order.
SEASONS = ["DJF", "MAM", "JJA", "SON"]


def season(time) -> Column:
    """Season name of a date; December belongs to DJF of its own year."""
    number = F.quarter(F.add_months(F.col(time) if isinstance(time, str) else time, 1))
    return F.element_at(F.array(*[F.lit(s) for s in SEASONS]), number)


def month_start(time) -> Column:
    """First day of the month as a date."""
    return F.trunc(F.col(time) if isinstance(time, str) else time, "month")


def day_angle(time) -> Column:
    """Day of year as an angle over a 365-day year; day 366 passes a full turn."""
    day = F.dayofyear(F.col(time) if isinstance(time, str) else time)
    return F.lit(2 * math.pi) * day / F.lit(365.0)
