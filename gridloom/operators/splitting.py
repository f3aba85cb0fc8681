"""Splitting and sampling. Random choices order rows by a seeded hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.numeric import col
from gridloom.operators.ranks import attach, hash_chunk, hash_order, positions, value_chunk


def uniform(seed, *parts) -> Column:
    """Reproducible number in [0, 1) from a seed and the row's key."""
    return F.conv(F.substring(hash_order(seed, *parts), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def hashed_uniform(seed: int, *parts) -> Column:
    """Like `uniform`, with a cheaper hash: for draws made once per row and pass."""
    bits = F.xxhash64(F.lit(seed), *[col(p) for p in parts])
    return F.pmod(bits, F.lit(2**31)) / F.lit(2.0**31)


def split_period(df: DataFrame, calib_end: str) -> DataFrame:
    """Calibration up to a date (included), validation after it."""
    part = F.when(F.col("time") <= F.lit(calib_end).cast("date"), "calibration").otherwise("validation")
    return df.withColumn("part", part)


def _held_out(pos: str, n: str, share: float) -> Column:
    return F.when(F.col(pos) <= F.ceil(F.col(n) * F.lit(share)), "valid").otherwise("train")


def split_stratified(
    df: DataFrame, value: str, threshold: float, share: float = 0.2, seed: int = 42
) -> DataFrame:
    """Days split within two strata: area mean at or above the threshold, or below."""
    days = df.groupBy("time").agg(F.avg(value).alias("_m"))
    days = days.select("time", F.coalesce((F.col("_m") >= threshold).cast("int"), F.lit(0)).alias("wet"))
    ordered = days.withColumn("_h", hash_order(seed, "time"))
    ranked = positions(ordered, ["wet"], ["_h"], hash_chunk("_h"), "_pos")
    sized = attach(ranked, days.groupBy("wet").agg(F.count(F.lit(1)).alias("_n")), ["wet"])
    return sized.select("time", "wet", _held_out("_pos", "_n", share).alias("part"))


def _axis(df: DataFrame) -> DataFrame:
    return df.select("time").distinct()


def _axis_positions(df: DataFrame) -> DataFrame:
    """Time axis with 1-based positions and its length."""
    axis = _axis(df)
    ranked = positions(axis, [], ["time"], F.trunc("time", "month"), "_pos")
    return attach(ranked, axis.agg(F.count(F.lit(1)).alias("_n")), [])


def split_random(df: DataFrame, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Each time step goes to train or valid at random; all cells share the split."""
    axis = _axis(df)
    ordered = axis.withColumn("_h", hash_order(seed, "time"))
    ranked = positions(ordered, [], ["_h"], hash_chunk("_h"), "_pos")
    sized = attach(ranked, axis.agg(F.count(F.lit(1)).alias("_n")), [])
    return df.join(sized.select("time", _held_out("_pos", "_n", share).alias("part")), ["time"])


def split_tail(df: DataFrame, share: float = 0.2) -> DataFrame:
    """The last time steps are the validation part."""
    axis = _axis_positions(df).withColumn("_back", F.col("_n") - F.col("_pos") + 1)
    return df.join(axis.select("time", _held_out("_back", "_n", share).alias("part")), ["time"])


def split_timeseries(df: DataFrame, folds: int = 10) -> DataFrame:
    """Expanding-window folds of the time axis: (fold, time, part).

    Every fold tests n // (folds + 1) steps and trains on all steps before.
    """
    axis = _axis_positions(df).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    size = F.floor(F.col("_n") / (folds + 1))
    start = F.col("_n") - (F.lit(folds) - F.col("fold") + 1) * size
    part = F.when(F.col("_pos") <= start, "train").when(F.col("_pos") <= start + size, "test")
    return axis.select("fold", "time", part.alias("part")).filter(F.col("part").isNotNull())


def _pick(df: DataFrame, axis: str, k: int, seed: int) -> DataFrame:
    return (
        df.select(axis).distinct().orderBy(hash_order(f"{seed}{axis}", axis), axis).limit(k)
    )


def sample_cells(df: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """All rows of the cells on k random rows and k random columns of the grid."""
    kept = df.join(_pick(df, "y", k, seed), ["y"], "left_semi")
    return kept.join(_pick(df, "x", k, seed), ["x"], "left_semi")


def sample_cells_repeat(df: DataFrame, k: int, seed: int = 42, width: float = 1000.0) -> DataFrame:
    """k draws with replacement on each axis; (iy, ix) number the drawn cells."""
    out = df
    for axis in ("y", "x"):
        nodes = df.select(axis).distinct()
        ranked = positions(nodes, [], [axis], value_chunk(axis, width), "_pos")
        n = nodes.agg(F.count(F.lit(1)).alias("n")).scalar()
        draws = df.sparkSession.range(1, k + 1).select(
            F.col("id").cast("int").alias(f"i{axis}"),
            (F.floor(uniform(f"{seed}{axis}", F.col("id")) * n) + 1).alias("_pos"),
        )
        out = out.join(draws.join(ranked, ["_pos"]).drop("_pos"), [axis])
    return out
