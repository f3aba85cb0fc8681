"""Metric index: pairs of balls within reach of each other, in any number of dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.sources.workspace import discard, stored

SLACK = 1e-9  # the index may pass a pair too many, never one too few


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    squares = F.zip_with(a, b, lambda p, q: (p - q) * (p - q))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))


def near_balls(balls: DataFrame, reach: float, leaf: int = 64, fan: int = 16) -> DataFrame:
    """Pairs (a, b) of different balls whose surfaces may be within `reach`; `a` has `asks` set.

    `balls` holds `key` (unique), `at` (centre as an array), `r` (radius) and `asks`. No pair within
    reach is missing. Space is cut by a tree of pivots: a cell with more than `leaf` members takes up
    to `fan` of them as pivots, chosen by a seeded hash, and a member moves to its nearest pivot. An
    asking ball visits every child that may hold a partner: by the triangle inequality, a member b of
    pivot p within s of a has d(a, p) <= d(b, p) + s and d(a, p) - min d(a, q) <= 2 s. Balls meet only
    in cells of at most `leaf` members. Pivots are members with centres of their own, so every split
    leaves smaller cells and the rounds end; equal centres, which nothing can part, end as a cell of
    their own. An empty table gives no pairs.
    """
    state = balls.select(F.lit("").alias("cell"), "key", "at", F.col("r").cast("double").alias("r"), "asks")
    members = stored(state.drop("asks"), "members")
    visitors = stored(state.filter("asks").drop("asks"), "visitors")
    found, level = None, 0
    while True:
        sizes = stored(
            members.groupBy("cell").agg(
                F.count(F.lit(1)).alias("n"), F.min("at").alias("least"), F.max("at").alias("most")
            ).select("cell", ((F.col("n") > leaf) & (F.col("least") != F.col("most"))).alias("split")),
            "sizes",
        )
        done, more = sizes.filter(~F.col("split")).select("cell"), sizes.filter("split").select("cell")
        met = visitors.select("cell", F.col("key").alias("a"), F.col("at").alias("_a"), F.col("r").alias("_ra")).join(
            members.join(done, ["cell"], "left_semi").select("cell", F.col("key").alias("b"), F.col("at").alias("_b"), F.col("r").alias("_rb")), ["cell"]
        )
        limit = (F.lit(reach) + F.col("_ra") + F.col("_rb")) * (1 + SLACK) + SLACK
        pairs = stored(met.filter((F.col("a") != F.col("b")) & (distance(F.col("_a"), F.col("_b")) <= limit)).select("a", "b"), "pairs")
        found = pairs if found is None else found.unionByName(pairs)
        if more.isEmpty():
            discard(members), discard(visitors), discard(sizes)
            return found
        pivots = stored(_pivots(members.join(more, ["cell"], "left_semi"), fan, level), "pivots")
        measured = _measured(members, pivots)
        parted = stored(measured.withColumn("to", F.array_min("_d")), "parted")
        children = parted.groupBy("cell", F.col("to.slot").alias("slot")).agg(
            F.max("to.d").alias("far"), F.min("to.d").alias("close"), F.max("r").alias("widest")
        )
        known = stored(children.groupBy("cell").agg(F.collect_list(F.struct("slot", "far", "close", "widest")).alias("_c")), "children")
        asked = _measured(visitors, pivots).join(known, ["cell"])

        def may_hold(child: Column) -> Column:
            s = (F.lit(reach) + F.col("r") + child["widest"]) * (1 + SLACK) + SLACK
            d = F.get(F.filter("_d", lambda p: p["slot"] == child["slot"]), F.lit(0))["d"]
            return (d <= child["far"] + s) & (d >= child["close"] - s) & (d - F.array_min("_d")["d"] <= 2 * s)

        visits = F.transform(F.filter("_c", may_hold), lambda child: child["slot"])
        next_visitors = stored(asked.select("cell", "key", "at", "r", F.explode(visits).alias("slot")).select(_child("slot"), "key", "at", "r"), "visitors")
        next_members = stored(parted.select(_child("to.slot"), "key", "at", "r"), "members")
        for old in (members, visitors, sizes, pivots, parted, known):
            discard(old)
        members, visitors, level = next_members, next_visitors, level + 1


def _child(slot: str) -> Column:
    return F.concat_ws(".", "cell", F.col(slot).cast("string")).alias("cell")


def _pivots(members: DataFrame, fan: int, level: int) -> DataFrame:
    """Up to `fan` distinct centres per cell, combined on the map side: the first by hash in each slot of a hash of the centre.

    The cell's least and greatest centre are pivots too, so there are always two different ones.
    """
    slot = F.pmod(F.xxhash64("at", F.lit(level)), F.lit(fan)).cast("int")
    chosen = members.groupBy("cell", slot.alias("slot")).agg(F.min_by("at", F.xxhash64("at", F.lit(~level))).alias("at"))
    ends = members.groupBy("cell").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    both = ends.select("cell", F.explode(F.array(F.struct(F.lit(fan).alias("slot"), F.col("lo").alias("at")), F.struct(F.lit(fan + 1).alias("slot"), F.col("hi").alias("at")))).alias("e"))
    return chosen.unionByName(both.select("cell", "e.*")).groupBy("cell").agg(F.collect_list(F.struct("slot", "at")).alias("_p"))


def _measured(balls: DataFrame, pivots: DataFrame) -> DataFrame:
    """Distance and slot of every pivot of the ball's cell."""
    gaps = F.transform("_p", lambda p: F.struct(distance(F.col("at"), p["at"]).alias("d"), p["slot"].alias("slot")))
    return balls.join(pivots, ["cell"]).withColumn("_d", gaps).drop("_p")
