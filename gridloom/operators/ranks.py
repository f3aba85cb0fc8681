"""Skew-safe ranks, running totals, row shifts and exact quantiles.

A window over a whole series puts that series into one task. The helpers here
cut every series into ordered chunks instead: a window runs inside a chunk,
and the small table of chunk totals carries the offset from one chunk to the
next, so no task ever sorts more than one chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridloom.functions.numeric import col
from gridloom.sources.workspace import stored


def attach(df: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Put group statistics beside the rows of their group.

    Without keys the statistics are one row and come in as a scalar subquery.
    With keys this is an equi-join: the adaptive planner broadcasts the
    statistics when their measured size allows it and splits hot keys when not.
    """
    if keys:
        return df.join(stats, keys, "left")
    one = stats.select(F.struct(*stats.columns).alias("one")).scalar()
    return df.withColumn("_one", one).select(*df.columns, "_one.*")


def time_chunk(ts, unit: str = "hour") -> Column:
    return F.date_trunc(unit, col(ts).cast("timestamp"))


def value_chunk(value, width: float = 1.0) -> Column:
    """Ordered chunk number of a numeric value."""
    return F.floor(col(value) / F.lit(float(width)))


def hash_order(seed, *parts) -> Column:
    """Reproducible pseudo-random sort key made of a seed and the row's key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(p).cast("string") for p in parts]))


def hash_chunk(order) -> Column:
    """First two hex digits: 256 ordered, even chunks of a hash order."""
    return F.substring(col(order), 1, 2)


def running_total(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    chunk: Column,
    addend: Column,
    out: str,
    peers: bool = False,
) -> DataFrame:
    """Running total of `addend` along `order` within `keys`.

    `chunk` must be non-decreasing along `order`. With `peers` rows of equal
    order see the same total (they must then share a chunk).
    """
    marked = df.withColumn("_chunk", chunk).withColumn("_add", addend)
    part = [*keys, "_chunk"]
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        marked.groupBy(*part)
        .agg(F.sum("_add").alias("_sum"))
        .select(*part, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    )
    inner = W.partitionBy(*part).orderBy(*order)
    inner = (
        inner.rangeBetween(W.unboundedPreceding, W.currentRow)
        if peers
        else inner.rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return (
        marked.withColumn("_run", F.sum("_add").over(inner))
        .join(offsets, part)
        .withColumn(out, F.col("_run") + F.col("_before"))
        .drop("_chunk", "_add", "_run", "_before")
    )


def positions(
    df: DataFrame, keys: list[str], order: list[str], chunk: Column, out: str = "pos"
) -> DataFrame:
    """1-based position of each row along `order` within `keys`."""
    return running_total(df, keys, order, chunk, F.lit(1), out)


def lead_rows(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    chunk: Column,
    values: list[str],
    steps: int,
    block: int = 65536,
) -> DataFrame:
    """Replace `values` by those `steps` rows further along the series.

    Rows are cut into blocks of `block` positions; the first `steps` rows of a
    block are copied to the block before, so a block is enough to look ahead.
    """
    if not 0 < steps <= block:
        raise ValueError("steps must lie between 1 and the block length")
    home = F.floor((F.col("_pos") - 1) / block)
    offset = (F.col("_pos") - 1) % block
    placed = (
        positions(df, keys, order, chunk, "_pos")
        .withColumn("_home", home)
        .withColumn(
            "_block",
            F.explode(
                F.when(
                    (offset < steps) & (F.col("_home") > 0),
                    F.array(F.col("_home"), F.col("_home") - 1),
                ).otherwise(F.array(F.col("_home")))
            ),
        )
    )
    w = W.partitionBy(*keys, "_block").orderBy("_pos")
    ahead = {v: F.lead(v, steps).over(w) for v in values}
    return (
        placed.withColumns(ahead)
        .filter(F.col("_block") == F.col("_home"))
        .drop("_pos", "_home", "_block")
    )


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: list[float],
    out: str = "q",
    margin: float = 1e-3,
    small: int = 3000,
    pieces: int = 256,
) -> DataFrame:
    """Exact linear-interpolated quantiles of groups of any size, one row per (keys, prob).

    A mergeable sketch brackets every wanted rank; only the values inside a
    bracket (about 4 x `margin` of the group) are ranked, in `pieces` ordered
    chunks, and the values below it are merely counted. Groups of fewer than
    `small` rows, for which a bracket could miss its rank, are ranked whole.
    The sketch errs by a tenth of the margin, so from there on it cannot miss.
    """
    if small * margin < 2.5:
        raise ValueError("small groups must cover at least 2.5 / margin rows")
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    ends = [(p, max(0.0, p - 2 * margin), min(1.0, p + 2 * margin)) for p in probs]
    steps = F.array(*[F.lit(float(e)) for _, lo, hi in ends for e in (lo, hi)])
    sketch = rows.groupBy(*keys).agg(
        F.count("_v").alias("_n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.percentile_approx("_v", steps, int(10 / margin)).alias("_steps"),
    )

    def bracket(i: int, p: float, lo: float, hi: float) -> Column:
        tiny = F.col("_n") < small
        start = F.col("_min") if lo == 0.0 else F.when(tiny, F.col("_min")).otherwise(F.get("_steps", F.lit(2 * i)))
        end = F.col("_max") if hi == 1.0 else F.when(tiny, F.col("_max")).otherwise(F.get("_steps", F.lit(2 * i + 1)))
        low = F.floor((F.col("_n") - 1) * F.lit(float(p)))
        return F.struct(
            F.lit(float(p)).alias("prob"), "_n", low.alias("_low"), start.alias("_from"), end.alias("_to")
        )

    brackets = sketch.select(*keys, F.array(*[bracket(i, *e) for i, e in enumerate(ends)]).alias("_bs"))
    if keys:
        # One row per group: stored, it is broadcast if small and the rows stay in place.
        brackets = stored(brackets, "brackets")
    place = ["prob", "_n", "_low", "_from", "_to"]
    counted = (
        attach(rows, brackets, keys)
        .select(*keys, "_v", F.explode("_bs").alias("_b"))
        .filter(F.col("_v") <= F.col("_b._to"))
        .groupBy(
            *keys,
            *[F.col(f"_b.{c}").alias(c) for c in place],
            F.when(F.col("_v") >= F.col("_b._from"), F.col("_v")).alias("_v"),
        )
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    within = F.try_divide(F.col("_v") - F.col("_from"), F.col("_to") - F.col("_from"))
    piece = F.when(F.col("_v").isNull(), F.lit(-1)).otherwise(
        F.coalesce(F.floor(within * pieces), F.lit(0))
    )
    # The row of everything below the bracket has no value and sorts first.
    ranked = running_total(counted, [*keys, "prob"], ["_v"], piece, F.col("_c"), "_upto")
    share = (F.col("_n") - 1) * F.col("prob") - F.col("_low")
    a = F.min(F.when(F.col("_upto") > F.col("_low"), F.col("_v")))
    b = F.min(F.when(F.col("_upto") > F.least(F.col("_low") + 1, F.col("_n") - 1), F.col("_v")))
    return (
        ranked.groupBy(*keys, "prob", "_n", "_low")
        .agg(a.alias("_a"), b.alias("_b"))
        .select(*keys, "prob", (F.col("_a") + (F.col("_b") - F.col("_a")) * share).alias(out))
    )


def quantile_columns(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Exact quantiles as one named column each."""
    long = exact_quantiles(df, keys, value, sorted(set(probs.values())))
    return long.groupBy(*keys).agg(
        *[F.max(F.when(F.col("prob") == p, F.col("q"))).alias(n) for n, p in probs.items()]
    )
