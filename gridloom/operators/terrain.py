"""Terrain: slope and aspect, tiles, histograms and elevation bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridloom.operators.ranks import attach, quantile_columns

BLOCK = 512


def _touching(index: str, block: int) -> Column:
    """Block offsets whose margin holds this row: its own, and a neighbour's at the rim."""
    inside = F.pmod(F.col(index), F.lit(block))
    return F.filter(
        F.array(
            F.lit(0),
            F.when(inside == 0, F.lit(-1)),
            F.when(inside == block - 1, F.lit(1)),
        ),
        lambda o: o.isNotNull(),
    )


def neighbours(
    dem: DataFrame, value: str = "elevation", cell: float = 1.0, block: int = BLOCK
) -> DataFrame:
    """The 3 x 3 surroundings of every cell as columns nw n ne w c e sw s se.

    The raster is cut into square blocks with a margin of one cell; all
    windows run inside a block, after one shuffle. North is the larger y.
    Beyond the border values continue linearly; at the corners the row is
    continued before the column is repeated.
    """
    row, column = F.round(F.col("y") / cell).cast("long"), F.round(F.col("x") / cell).cast("long")
    placed = (
        dem.select("y", "x", F.col(value).alias("v"))
        .withColumn("_r", row)
        .withColumn("_c", column)
        .withColumn("_dy", F.explode(_touching("_r", block)))
        .withColumn("_dx", F.explode(_touching("_c", block)))
        .withColumn("_by", F.floor(F.col("_r") / block) + F.col("_dy"))
        .withColumn("_bx", F.floor(F.col("_c") / block) + F.col("_dx"))
        .repartition("_by", "_bx")
    )
    along = W.partitionBy("_by", "_bx", "_c").orderBy("_r")
    north = F.when(F.lead("_r").over(along) == F.col("_r") + 1, F.lead("v").over(along))
    south = F.when(F.lag("_r").over(along) == F.col("_r") - 1, F.lag("v").over(along))
    columns = placed.withColumn("_n0", north).withColumn("_s0", south)
    v = F.col("v")
    columns = columns.select(
        "*",
        (F.col("_n0").isNull() | F.col("_s0").isNull()).alias("_rim"),
        F.coalesce("_n0", 2 * v - F.col("_s0"), v).alias("_n"),
        F.coalesce("_s0", 2 * v - F.col("_n0"), v).alias("_s"),
    )
    across = W.partitionBy("_by", "_bx", "_r").orderBy("_c")
    out = columns
    for near, step in (("e", 1), ("w", -1)):
        shift = F.lead if step == 1 else F.lag
        beside = shift("_c").over(across) == F.col("_c") + step
        for src, name in (("_n", f"n{near}"), ("v", f"{near}"), ("_s", f"s{near}")):
            out = out.withColumn(f"_{name}0", F.when(beside, shift(src).over(across)))

    def side(name: str, other: str, centre: str) -> Column:
        own = F.col(centre)
        continued = F.when(F.col("_rim"), own).otherwise(2 * own - F.col(f"_{other}0"))
        return F.coalesce(F.col(f"_{name}0"), continued, own)

    return out.filter((F.col("_dy") == 0) & (F.col("_dx") == 0)).select(
        "y",
        "x",
        side("nw", "ne", "_n").alias("nw"),
        F.col("_n").alias("n"),
        side("ne", "nw", "_n").alias("ne"),
        side("w", "e", "v").alias("w"),
        F.col("v").alias("c"),
        side("e", "w", "v").alias("e"),
        side("sw", "se", "_s").alias("sw"),
        F.col("_s").alias("s"),
        side("se", "sw", "_s").alias("se"),
    )


def _gradients() -> tuple[Column, Column]:
    c = F.col
    east = (c("ne") + 2 * c("e") + c("se")) - (c("nw") + 2 * c("w") + c("sw"))
    south = (c("sw") + 2 * c("s") + c("se")) - (c("nw") + 2 * c("n") + c("ne"))
    return east, south


def dem_slope(
    dem: DataFrame, value: str = "elevation", cell: float = 1.0, scale: float = 1.0, block: int = BLOCK
) -> DataFrame:
    """Slope in degrees from the eight neighbours (Horn's weights).

    `scale` is the number of vertical units per horizontal unit; with the
    default 1 a grid in degrees yields near-vertical slopes.
    """
    east, south = _gradients()
    rise = F.sqrt((east / cell) ** 2 + (south / cell) ** 2) / F.lit(8.0 * scale)
    return neighbours(dem, value, cell, block).select("y", "x", F.degrees(F.atan(rise)).alias("slope"))


def dem_aspect(
    dem: DataFrame, value: str = "elevation", cell: float = 1.0, block: int = BLOCK
) -> DataFrame:
    """Downslope direction in degrees clockwise from north; NULL on flat ground."""
    east, south = _gradients()
    turn = F.degrees(F.atan2(south, -east))
    compass = F.when(turn > 90, 450 - turn).otherwise(90 - turn)
    compass = F.when(compass == 360, F.lit(0.0)).otherwise(compass)
    flat = (east == 0) & (south == 0)
    return neighbours(dem, value, cell, block).select("y", "x", F.when(~flat, compass).alias("aspect"))


def static_broadcast(cube: DataFrame, static: DataFrame) -> DataFrame:
    """Repeat per-cell columns over all times (and members) of a cube.

    An equi-join on the cell: the planner broadcasts the static table when its
    measured size is small enough and shuffles both sides otherwise.
    """
    return cube.join(static, ["y", "x"], "left")


def tile_id(
    grid: DataFrame, value: str, size: int, pad: bool = False, cval: float = 0.0
) -> DataFrame:
    """Square tiles numbered row by row; rows and columns are 0-based integers.

    With `pad` the grid is padded around its centre up to whole tiles;
    without, a grid that does not divide evenly is an error.
    """
    shape = grid.agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w")).first()
    extra_y, extra_x = -shape.h % size, -shape.w % size
    if (extra_y or extra_x) and not pad:
        raise ValueError(f"grid {shape.h} x {shape.w} does not divide into tiles of {size}")
    top, left = extra_y // 2, extra_x // 2
    rows = [i for i in range(top)] + [top + shape.h + i for i in range(extra_y - top)]
    cols = [i for i in range(left)] + [left + shape.w + i for i in range(extra_x - left)]

    def each(values):
        return F.explode(F.array(*[F.lit(int(i)).cast("long") for i in values]))

    row = (F.col("y") + top).cast("long").alias("row")
    col = (F.col("x") + left).cast("long").alias("col")
    fill = F.lit(float(cval)).alias(value)
    out = grid.select(row, col, F.col(value).cast("double").alias(value))
    if cols:
        out = out.unionByName(
            grid.select("y").distinct().select(row, each(cols).alias("col"), fill)
        )
    if rows:
        out = out.unionByName(
            grid.select("x").distinct().select(each(rows).alias("row"), col, fill)
        )
    if rows and cols:
        corner = grid.sparkSession.range(1).select(each(rows).alias("row"))
        out = out.unionByName(corner.select("row", each(cols).alias("col"), fill))
    per_row = (shape.w + extra_x) // size
    return out.select(
        (F.floor(F.col("row") / size) * per_row + F.floor(F.col("col") / size)).alias("tile"),
        (F.col("row") % size).alias("row"),
        (F.col("col") % size).alias("col"),
        value,
    )


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width histogram between the extremes; the last bin is closed."""
    known = df.filter(F.col(value).isNotNull()).select(F.col(value).alias("_v"))
    ends = known.agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.least(F.floor(F.try_divide(F.col("_v") - F.col("_lo"), width)), F.lit(bins - 1))
    counts = attach(known, ends, []).agg(
        F.first("_lo").alias("_lo"),
        F.first("_hi").alias("_hi"),
        *[F.count_if(F.coalesce(place, F.lit(0)) == i).alias(f"_b{i}") for i in range(bins)],
    )
    table = F.array(
        *[
            F.struct(
                F.lit(i).alias("bin"),
                (F.col("_lo") + width * i).alias("lo"),
                (F.col("_lo") + width * (i + 1)).alias("hi"),
                F.col(f"_b{i}").alias("n"),
            )
            for i in range(bins)
        ]
    )
    return counts.select(F.explode(table).alias("_e")).select("_e.*")


def elevation_bands(
    dem: DataFrame, value: str = "elevation", low: float = 0.1, high: float = 0.9
) -> DataFrame:
    """Global elevation quantiles beside each cell, with masks below and above the band."""
    probs = {"q10": 0.1, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9, "_low": low, "_high": high}
    quantiles = quantile_columns(dem, [], value, probs)
    return (
        attach(dem, quantiles, [])
        .withColumn("below", (F.col(value) < F.col("_low")).cast("int"))
        .withColumn("above", (F.col(value) > F.col("_high")).cast("int"))
        .drop("_low", "_high")
    )
