"""Ensembles: collapsing members and probabilistic scores.

Members are rows. A group of members of one (time, cell) is bounded by the
ensemble size, so windows inside it are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridloom.functions.calendar import season
from gridloom.operators.ranks import attach

CUBE = ["time", "y", "x"]


def ens_mean(ens: DataFrame, value: str = "pred", keys: list[str] = CUBE) -> DataFrame:
    return ens.groupBy(*keys).agg(F.avg(value).alias(value))


def ens_median(ens: DataFrame, value: str = "pred", keys: list[str] = CUBE) -> DataFrame:
    return ens.groupBy(*keys).agg(F.median(value).alias(value))


def ens_quantile_band(
    ens: DataFrame, weight: Column, value: str = "pred", probs: tuple[float, ...] = (0.25, 0.5, 0.75)
) -> DataFrame:
    """Weighted area mean per member, its calendar-month mean, quantiles across members."""
    area = ens.groupBy("time", "member").agg(
        F.try_divide(
            F.sum(weight * F.col(value)), F.sum(F.when(F.col(value).isNotNull(), weight))
        ).alias(value)
    )
    months = area.groupBy(F.month("time").alias("month"), "member").agg(F.avg(value).alias(value))
    return months.groupBy("month").agg(
        *[F.percentile(value, p).alias(f"q{round(p * 100)}") for p in probs]
    )


def crps(ens: DataFrame, obs: DataFrame, value: str = "pred", truth: str = "truth") -> DataFrame:
    """Continuous ranked probability score of each (time, cell).

    Mean distance of the members to the truth minus half their mean distance
    to each other; the latter follows from the sorted members alone, so
    members are never paired.
    """
    rank = F.row_number().over(W.partitionBy(*CUBE).orderBy(value))
    size = F.count(F.lit(1)).over(W.partitionBy(*CUBE))
    ranked = (
        ens.filter(F.col(value).isNotNull())
        .select(*CUBE, F.col(value).alias("_x"), rank.alias("_i"), size.alias("_m"))
        .withColumn("_s", (2 * F.col("_i") - F.col("_m") - 1) * F.col("_x"))
    )
    m = F.col("_m").cast("double")
    known = obs.filter(F.col(truth).isNotNull()).select(*CUBE, truth)
    return (
        ranked.join(known, CUBE)
        .groupBy(*CUBE)
        .agg((F.avg(F.abs(F.col("_x") - F.col(truth))) - F.sum(F.col("_s") / (m * m))).alias("crps"))
    )


def crps_mean(scores: DataFrame, keys: list[str]) -> DataFrame:
    """CRPS averaged over what `keys` leaves out: ["y", "x"] a map, ["time"] a series."""
    return scores.groupBy(*keys).agg(F.avg("crps").alias("crps"))


def crps_season(scores: DataFrame) -> DataFrame:
    return scores.groupBy("y", "x", season("time").alias("season")).agg(F.avg("crps").alias("crps"))


def spread_error_cell(ens: DataFrame, obs: DataFrame, value: str = "pred", truth: str = "truth") -> DataFrame:
    """Per cell: mean member spread over time divided by the members' mean RMSE."""
    spread = (
        ens.groupBy(*CUBE)
        .agg(F.stddev_pop(value).alias("s"))
        .groupBy("y", "x")
        .agg(F.avg("s").alias("spread"))
    )
    error = F.col(value) - F.col(truth)
    rmse = (
        ens.join(obs.select(*CUBE, truth), CUBE)
        .groupBy("y", "x", "member")
        .agg(F.sqrt(F.avg(error * error)).alias("e"))
        .groupBy("y", "x")
        .agg(F.avg("e").alias("rmse"))
    )
    return spread.join(rmse, ["y", "x"]).withColumn("ratio", F.try_divide("spread", "rmse"))


def spread_error_season(
    ens: DataFrame, obs: DataFrame, value: str = "pred", truth: str = "truth", root: bool = False
) -> DataFrame:
    """Member spread over one overall error of the ensemble mean, averaged by cell and season.

    The error is the mean square; `root` takes its root.
    """
    per_step = ens.groupBy(*CUBE).agg(F.stddev_pop(value).alias("spread"), F.avg(value).alias("mean"))
    gap = F.col(truth) - F.col("mean")
    mse = per_step.join(obs.select(*CUBE, truth), CUBE).agg(F.avg(gap * gap).alias("error"))
    if root:
        mse = mse.select(F.sqrt("error").alias("error"))
    return (
        attach(per_step, mse, [])
        .groupBy("y", "x", season("time").alias("season"))
        .agg(F.avg(F.try_divide("spread", "error")).alias("ratio"))
    )


def rps(
    ens: DataFrame, obs: DataFrame, edges: list[float], value: str = "pred", truth: str = "truth"
) -> DataFrame:
    """Ranked probability score over category edges, mean over time per cell."""
    marked = obs.select(*CUBE, truth, *[F.lit(float(e)).alias(f"e{i}") for i, e in enumerate(edges)])
    return _rps(ens, marked, len(edges), value, truth)


def rps_terciles(ens: DataFrame, obs: DataFrame, value: str = "pred", truth: str = "truth") -> DataFrame:
    """The same with each cell's own climatological terciles as edges.

    A tercile may be one of the values, so values and edges are compared to nine decimals.
    """
    obs = obs.select(*CUBE, F.round(truth, 9).alias(truth))
    edges = obs.groupBy("y", "x").agg(
        F.round(F.percentile(truth, 1 / 3), 9).alias("e0"), F.round(F.percentile(truth, 2 / 3), 9).alias("e1")
    )
    return _rps(ens, attach(obs, edges, ["y", "x"]), 2, value, truth)


def _rps(ens: DataFrame, marked: DataFrame, n: int, value: str, truth: str) -> DataFrame:
    steps = (
        ens.filter(F.col(value).isNotNull())
        .join(marked.filter(F.col(truth).isNotNull()), CUBE)
        .groupBy(*CUBE)
        .agg(
            *[F.avg((F.col(value) < F.col(f"e{i}")).cast("double")).alias(f"f{i}") for i in range(n)],
            *[F.max((F.col(truth) < F.col(f"e{i}")).cast("double")).alias(f"o{i}") for i in range(n)],
        )
    )
    score = sum(((F.col(f"f{i}") - F.col(f"o{i}")) ** 2 for i in range(n)), F.lit(0.0))
    return steps.groupBy("y", "x").agg(F.avg(score).alias("rps"))


def rank_histogram(ens: DataFrame, obs: DataFrame, value: str = "pred", truth: str = "truth") -> DataFrame:
    """How often the truth takes each rank among the members."""
    ranks = (
        ens.filter(F.col(value).isNotNull())
        .join(obs.filter(F.col(truth).isNotNull()).select(*CUBE, truth), CUBE)
        .groupBy(*CUBE)
        .agg((1 + F.count_if(F.col(value) < F.col(truth))).cast("int").alias("rank"))
    )
    return ranks.groupBy("rank").agg(F.count(F.lit(1)).alias("n"))
