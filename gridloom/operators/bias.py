"""Bias correction by quantile mapping, per cell.

Equal values of a cell are folded into one row with their numbers in the observation, the model and the
scenario. One ordering of these rows gives the empirical distribution and all ranks; quantiles are looked
up by (cell, block of ranks). So a dry cell's zeros are one row, and no series is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridloom.operators.ranks import value_chunk
from gridloom.sources.workspace import stored

RANK_BLOCK = 16  # ranks of one lookup key: at most so many values share it


def ladder(obs: DataFrame, mod: DataFrame, scenario: DataFrame, value: str, keys: list[str], width: float | None = None) -> DataFrame:
    """(keys, v, obs, mod, asked, obs_to, mod_to): the distinct values with their numbers and running numbers.

    The merged values are cut into ordered chunks, by default along borders that the planner samples from
    them (equal depth, a hot cell is many chunks), with `width` into equal spans. A window runs inside a
    chunk, and the table of chunk totals carries the offset.
    """
    names = ["obs", "mod", "asked"]
    merged = None
    for name, df in zip(names, (obs, mod, scenario), strict=True):
        rows = df.filter(F.col(value).isNotNull()).select(
            *keys, F.col(value).cast("double").alias("v"), *[F.lit(int(n == name)).cast("long").alias(n) for n in names]
        )
        merged = rows if merged is None else merged.unionByName(rows)
    folded = merged.groupBy(*keys, "v").agg(*[F.sum(n).alias(n) for n in names])
    if width is None:
        chunked = folded.repartitionByRange(*keys, "v").withColumn("_chunk", F.spark_partition_id())
    else:
        chunked = folded.withColumn("_chunk", value_chunk("v", width))
    chunked = stored(chunked, "ladder")
    part = [*keys, "_chunk"]
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy(*part).orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)
    totals = chunked.groupBy(*part).agg(*[F.sum(n).alias(f"_{n}") for n in names[:2]])
    offsets = totals.select(*part, *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in names[:2]])
    running = chunked.select("*", *[F.sum(n).over(inside).alias(f"{n}_to") for n in names[:2]]).join(offsets, part)
    return stored(running.select(*keys, "v", *names, *[(F.col(f"{n}_to") + F.col(f"_{n}")).alias(f"{n}_to") for n in names[:2]]), "ranks")


def _block(rank: Column) -> Column:
    return F.floor(rank / RANK_BLOCK).cast("long")


def _at_ranks(steps: DataFrame, asks: DataFrame, keys: list[str]) -> DataFrame:
    """The values at the ranks h and h + 1 (0-based) of both distributions for every asked value."""
    kinds = ["obs", "mod"]
    held = F.explode(
        F.filter(
            F.array(*[F.struct(F.lit(n).alias("kind"), (F.col(f"{n}_to") - F.col(n)).alias("lo"), F.col(f"{n}_to").alias("hi")) for n in kinds]),
            lambda s: s["hi"] > s["lo"],
        )
    )
    holders = steps.select(*keys, F.col("v").alias("held"), held.alias("s")).select(
        *keys, "held", "s.*", F.explode(F.sequence(_block(F.col("s.lo")), _block(F.col("s.hi") - 1))).alias("block")
    )
    wanted = F.explode(
        F.array(*[F.struct(F.lit(n).alias("kind"), F.lit(up).alias("up"), (F.floor(f"h_{n}") + up).alias("k")) for n in kinds for up in (0, 1)])
    )
    looked = asks.select(*keys, "v", wanted.alias("w")).select(*keys, "v", "w.*", _block(F.col("w.k")).alias("block"))
    met = looked.join(holders, [*keys, "kind", "block"]).filter((F.col("k") >= F.col("lo")) & (F.col("k") < F.col("hi")))
    picked = [F.max(F.when((F.col("kind") == n) & (F.col("up") == up), F.col("held"))).alias(f"{n}_{up}") for n in kinds for up in (0, 1)]
    return met.groupBy(*keys, "v").agg(*picked)


def quantile_map(
    obs: DataFrame,
    mod: DataFrame,
    scenario: DataFrame,
    value: str,
    keys: list[str] | None = None,
    modified: bool = False,
    width: float | None = None,
) -> DataFrame:
    """Shift each scenario value by the difference of observed and modelled quantiles.

    All three frames hold `value`. The `modified` form also rescales by the
    ratio of medians and of interquartile ranges. `width` sets the span of
    values ranked by one task; without it the borders come from the data.
    Missing values and cells without calibration stay, with a NULL correction.
    """
    keys = keys or ["y", "x"]
    steps = ladder(obs, mod, scenario, value, keys, width)
    sizes = [F.sum(n).alias(f"n_{n}") for n in ("obs", "mod")]
    if modified:
        quartiles = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
        sizes += [F.percentile("v", quartiles, F.col(n)).alias(f"q_{n}") for n in ("obs", "mod")]
    cells = steps.groupBy(*keys).agg(*sizes).filter("n_obs > 0 and n_mod > 0")
    share = F.col("mod_to") / F.col("n_mod")
    asks = steps.filter("asked > 0").join(cells, keys).withColumns({f"h_{n}": share * (F.col(f"n_{n}") - 1) for n in ("obs", "mod")})

    def quantile(n: str) -> Column:
        low, high, h = F.col(f"{n}_0"), F.col(f"{n}_1"), F.col(f"h_{n}")
        return low + F.coalesce((high - low) * (h - F.floor(h)), F.lit(0.0))

    shift = quantile("obs") - quantile("mod")
    if modified:
        middle = F.col("q_obs")[1] - F.col("q_mod")[1]
        g = F.try_divide(F.col("q_obs")[1], F.col("q_mod")[1])
        f = F.try_divide(F.col("q_obs")[2] - F.col("q_obs")[0], F.col("q_mod")[2] - F.col("q_mod")[0])
        shift = g * middle + f * (shift - middle)
    shifts = asks.join(_at_ranks(steps, asks, keys), [*keys, "v"]).select(*keys, F.col("v").alias("_v"), shift.alias("_shift"))
    placed = scenario.withColumn("_v", F.col(value).cast("double")).join(shifts, [*keys, "_v"], "left")
    return placed.select(*scenario.columns, (F.col(value) + F.col("_shift")).alias("corrected"))
