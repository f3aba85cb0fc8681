"""Remapping a cube onto another rectilinear grid.

Weights are separable, so they are found on each axis alone: the coordinates of
an axis, source and target, are sorted together once and every coordinate takes
the nearest source coordinate before and after it. Both axes go through the
same pass. No two-dimensional range join, and no task sorts more than one
stretch of an axis.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridloom.operators.ranks import value_chunk
from gridloom.sources.workspace import stored

AXES = ("y", "x")


def carry(
    df: DataFrame,
    coord: str,
    width: float,
    before: dict[str, tuple[Column, bool]] | None = None,
    after: dict[str, tuple[Column, bool]] | None = None,
) -> DataFrame:
    """Nearest marked value before / after each distinct coordinate of each axis.

    Each entry maps an output name to (expression, include_own_row); the
    expression must grow with the coordinate and be NULL on unmarked rows.
    """
    before, after = before or {}, after or {}
    marks = {n: e for n, (e, _) in {**before, **after}.items()}
    rows = df.withColumn("_chunk", value_chunk(coord, width)).withColumns(
        {f"_m_{n}": e for n, e in marks.items()}
    )
    totals = rows.groupBy("axis", "_chunk").agg(
        *[F.max(f"_m_{n}").alias(f"_t_{n}") for n in before],
        *[F.min(f"_m_{n}").alias(f"_t_{n}") for n in after],
    )
    past = W.partitionBy("axis").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    future = W.partitionBy("axis").orderBy("_chunk").rowsBetween(1, W.unboundedFollowing)
    offsets = totals.select(
        "axis",
        "_chunk",
        *[F.max(f"_t_{n}").over(past).alias(f"_o_{n}") for n in before],
        *[F.min(f"_t_{n}").over(future).alias(f"_o_{n}") for n in after],
    )
    w = W.partitionBy("axis", "_chunk").orderBy(coord)
    near = {}
    for n, (_, own) in before.items():
        near[n] = F.max(f"_m_{n}").over(w.rowsBetween(W.unboundedPreceding, 0 if own else -1))
    for n, (_, own) in after.items():
        near[n] = F.min(f"_m_{n}").over(w.rowsBetween(0 if own else 1, W.unboundedFollowing))
    return (
        rows.select("*", *[e.alias(f"_n_{n}") for n, e in near.items()])
        .join(offsets, ["axis", "_chunk"])
        .select(*df.columns, *[F.coalesce(f"_n_{n}", f"_o_{n}").alias(n) for n in near])
    )


def cube_axes(cube: DataFrame) -> DataFrame:
    """Distinct coordinates of both axes: (axis, c)."""
    both = F.array(
        *[F.struct(F.lit(a).alias("axis"), F.col(a).cast("double").alias("c")) for a in AXES]
    )
    return cube.select(F.explode(both).alias("_e")).select("_e.*").distinct()


def _tagged(target_y: DataFrame, target_x: DataFrame) -> DataFrame:
    """Two target axes in one frame, under an axis column."""
    return target_y.withColumn("axis", F.lit("y")).unionByName(target_x.withColumn("axis", F.lit("x")))


def bilinear_axes(source: DataFrame, target: DataFrame, width: float) -> DataFrame:
    """Source nodes and weights of every target node; both frames hold (axis, c).

    Returns (axis, t, s, w, n); a target between two nodes has two rows, one on
    a node has one. A target outside the source axis keeps the edge node with a
    NULL weight, so its result is missing rather than dropped.
    """
    nodes = (
        source.select("axis", "c", F.lit(1).alias("src"), F.lit(0).alias("dst"))
        .unionByName(target.select("axis", "c", F.lit(0).alias("src"), F.lit(1).alias("dst")))
        .groupBy("axis", "c")
        .agg(F.max("src").alias("src"), F.max("dst").alias("dst"))
    )
    mark = F.when(F.col("src") == 1, F.col("c"))
    found = carry(nodes, "c", width, {"lo": (mark, True)}, {"hi": (mark, True)}).filter("dst = 1")
    span = F.col("hi") - F.col("lo")

    def entry(s: Column, w: Column, n: int) -> Column:
        return F.struct(s.cast("double").alias("s"), w.cast("double").alias("w"), F.lit(n).alias("n"))

    lo, hi, c = F.col("lo"), F.col("hi"), F.col("c")
    pairs = (
        F.when(lo == hi, F.array(entry(lo, F.lit(1.0), 1)))
        .when(span.isNotNull(), F.array(entry(lo, (hi - c) / span, 2), entry(hi, (c - lo) / span, 2)))
        .otherwise(F.array(entry(F.coalesce(lo, hi), F.lit(None), 1)))
    )
    return found.select("axis", F.col("c").alias("t"), F.explode(pairs).alias("e")).select(
        "axis", "t", "e.s", "e.w", "e.n"
    )


def _on_axes(cube: DataFrame, weights: DataFrame) -> DataFrame:
    """Attach the weights (axis, t, s, w, n) to the cube; `_w` is their product.

    The table is as long as the axes and is stored first, so the planner knows
    its size: it broadcasts it and leaves the cube where it is.
    """
    table = stored(weights, "axes")
    out = cube
    for axis in AXES:
        part = table.filter(F.col("axis") == axis).select(
            *[F.col(c).alias(f"_{c}{axis}") for c in ("s", "t", "w", "n")]
        )
        out = out.withColumn(f"_s{axis}", F.col(axis).cast("double")).join(part, [f"_s{axis}"])
    return out.withColumn("_w", F.col("_wy") * F.col("_wx"))


def regrid_bilinear(
    cube: DataFrame,
    target_y: DataFrame,
    target_x: DataFrame,
    keys: list[str],
    values: list[str],
    width: float = 1000.0,
) -> DataFrame:
    """Bilinear remap onto the grid spanned by two target axes (columns y and x).

    A target value is missing when any of its source corners is missing.
    `width` is the stretch of an axis, in coordinate units, sorted by one task.
    """
    target = _tagged(
        target_y.select(F.col("y").cast("double").alias("c")),
        target_x.select(F.col("x").cast("double").alias("c")),
    )
    spread = _on_axes(cube, bilinear_axes(cube_axes(cube), target, width))
    full = F.max(F.col("_ny") * F.col("_nx"))
    return spread.groupBy(*keys, F.col("_ty").alias("y"), F.col("_tx").alias("x")).agg(
        *[
            F.when(F.count(F.col("_w") * F.col(v)) == full, F.sum(F.col("_w") * F.col(v))).alias(v)
            for v in values
        ]
    )


def axis_cells(nodes: DataFrame, width: float) -> DataFrame:
    """Cell bounds halfway between neighbouring nodes (axis, c): (axis, node, lo, hi)."""
    own = F.col("c")
    near = carry(nodes, "c", width, {"p": (own, False)}, {"q": (own, False)})
    down = F.coalesce(own - F.col("p"), F.col("q") - own) / 2
    up = F.coalesce(F.col("q") - own, own - F.col("p")) / 2
    return near.select("axis", own.alias("node"), (own - down).alias("lo"), (own + up).alias("hi"))


def overlap_axes(source: DataFrame, target: DataFrame, width: float, sphere: bool) -> DataFrame:
    """Overlap of source and target cells (axis, node, lo, hi) on each axis.

    All edges are sorted together; between two consecutive edges lies one
    piece, which belongs to the last source cell and the last target cell that
    began. Returns (axis, t, s, w), w being the length or, for y on the
    `sphere`, the difference of the sine of latitude.
    """
    cell = F.struct(F.col("lo"), F.col("hi"), F.col("node"))
    none = F.lit(None).cast("struct<lo:double,hi:double,node:double>")
    source = source.select("axis", *[F.col(c).cast("double").alias(c) for c in ("node", "lo", "hi")])
    target = target.select("axis", *[F.col(c).cast("double").alias(c) for c in ("node", "lo", "hi")])
    edges = source.select("axis", F.col("lo").alias("c"), cell.alias("src"), none.alias("dst"))
    for part in (
        source.select("axis", F.col("hi").alias("c"), none.alias("src"), none.alias("dst")),
        target.select("axis", F.col("lo").alias("c"), none.alias("src"), cell.alias("dst")),
        target.select("axis", F.col("hi").alias("c"), none.alias("src"), none.alias("dst")),
    ):
        edges = edges.unionByName(part)
    edges = edges.groupBy("axis", "c").agg(F.max("src").alias("src"), F.max("dst").alias("dst"))
    pieces = carry(
        edges,
        "c",
        width,
        {"s": (F.col("src"), True), "t": (F.col("dst"), True)},
        {"next": (F.col("c"), False)},
    ).filter((F.col("s.hi") > F.col("c")) & (F.col("t.hi") > F.col("c")) & F.col("next").isNotNull())
    length = F.col("next") - F.col("c")
    if sphere:
        band = F.sin(F.radians("next")) - F.sin(F.radians("c"))
        length = F.when(F.col("axis") == "y", band).otherwise(length)
    return (
        pieces.select("axis", F.col("t.node").alias("t"), F.col("s.node").alias("s"), length.alias("w"))
        .groupBy("axis", "t", "s")
        .agg(F.sum("w").alias("w"))
    )


def _weighted(value: str, weight: str) -> Column:
    """Aggregate: weighted mean over the rows that have a value."""
    return F.try_divide(
        F.sum(F.col(weight) * F.col(value)), F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))
    ).alias(value)


def regrid_conservative(
    cube: DataFrame,
    target_y: DataFrame,
    target_x: DataFrame,
    keys: list[str],
    values: list[str],
    sphere: bool = True,
    width: float = 1000.0,
) -> DataFrame:
    """Area-weighted remap; targets are cells (node, lo, hi) on each axis.

    Missing source values carry no weight.
    """
    source = axis_cells(cube_axes(cube), width)
    names = ["node", "lo", "hi"]
    target = _tagged(target_y.select(*names), target_x.select(*names))
    weights = overlap_axes(source, target, width, sphere).withColumn("n", F.lit(1))
    spread = _on_axes(cube, weights)
    return spread.groupBy(*keys, F.col("_ty").alias("y"), F.col("_tx").alias("x")).agg(
        *[_weighted(v, "_w") for v in values]
    )


def regrid_weights(
    cube: DataFrame, weights: DataFrame, keys: list[str], values: list[str]
) -> DataFrame:
    """Remap with a given table (src_y, src_x, dst_y, dst_x, w), e.g. for curvilinear grids."""
    placed = cube.join(weights.withColumnsRenamed({"src_y": "y", "src_x": "x"}), ["y", "x"])
    return placed.groupBy(*keys, F.col("dst_y").alias("y"), F.col("dst_x").alias("x")).agg(
        *[_weighted(v, "w") for v in values]
    )
