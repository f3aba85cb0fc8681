"""Cubes along a space-filling curve, so that a small box of time and space reads few row groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 16  # lattice steps of an axis: 2 ** BITS


def interleaved(positions: list[Column], bits: int = BITS) -> Column:
    """Z-order of whole numbers below 2 ** bits: their bits, taken in turn."""
    if bits * len(positions) > 62:
        raise ValueError("bits times axes must not exceed 62")
    total = F.lit(0).cast("long")
    for bit in range(bits):
        for i, position in enumerate(positions):
            one = F.shiftright(position, bit).bitwiseAND(F.lit(1).cast("long"))
            total = total.bitwiseOR(F.shiftleft(one, bit * len(positions) + i))
    return total


def _number(df: DataFrame, axis: str) -> Column:
    if isinstance(df.schema[axis].dataType, T.DateType):
        return F.datediff(axis, F.lit("1970-01-01").cast("date")).cast("double")
    if isinstance(df.schema[axis].dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(axis).cast("timestamp")).cast("double")
    return F.col(axis).cast("double")


def write_ordered(
    df: DataFrame,
    path: str,
    axes: tuple[str, ...] = ("time", "y", "x"),
    file_rows: int = 16_000_000,
    group_rows: int = 250_000,
    bits: int = BITS,
) -> None:
    """Write a cube in Z-order of its axes; `file_rows` and `group_rows` are the sizes of files and row groups.

    Each axis is cut into equal steps between its extremes (one aggregate, one row on the driver). Rows are
    ranged and sorted by the interleaved steps, so a row group is a small box, and its least and greatest
    values let readers skip it. Rows with a missing axis value come first. Rows of one lattice step are
    ordered by the axes themselves.
    """
    numbers = {a: _number(df, a) for a in axes}
    extremes = [f(c).alias(f"{n}_{a}") for a, c in numbers.items() for n, f in (("lo", F.min), ("hi", F.max))]
    known = df.agg(F.count(F.lit(1)).alias("rows"), *extremes).first()
    steps = []
    for a, c in numbers.items():
        low, span = known[f"lo_{a}"], (known[f"hi_{a}"] or 0.0) - (known[f"lo_{a}"] or 0.0)
        share = (c - F.lit(low)) / F.lit(span) if span else F.lit(0.0)
        steps.append(F.coalesce(F.floor(share * (2**bits - 1)).cast("long"), F.lit(0).cast("long")))
    files = max(1, -(-known["rows"] // file_rows))
    (
        df.withColumn("_z", interleaved(steps, bits))
        .repartitionByRange(files, "_z", *axes)
        .sortWithinPartitions("_z", *axes)
        .drop("_z")
        .write.option("compression", "zstd")
        .option("parquet.block.row.count.limit", group_rows)
        .parquet(path)
    )
