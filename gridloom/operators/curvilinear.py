"""Remapping from grids whose nodes have coordinates of their own (projected, rotated or otherwise curved grids).

A source grid is a table (y, x, lat, lon): whole index numbers, one row per node. Weight tables
(src_y, src_x, dst_y, dst_x, w) are made once for a pair of grids and applied to any cube.

Neighbours are found without a range join: the quads' bounding boxes and the targets are dealt to the bins of
a lattice about twice as wide as a quad, and meet by equi-join of the bin. Longitudes are compared on the circle, so
a grid may lie across the date line. Everything is a Spark expression.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.regrid import regrid_weights
from gridloom.sources.workspace import stored

EDGE = 1e-9  # a point this far outside a quad, in its own coordinates, still belongs to it
OUTSIDE = 64
TURN = 360.0


def near(lon: Column, to: Column) -> Column:
    """The longitude on the turn that is closest to another one."""
    return lon - F.lit(TURN) * F.round((lon - to) / F.lit(TURN))


def quads(nodes: DataFrame) -> DataFrame:
    """Quads between four neighbouring nodes: y, x (of the first), p00, p01, p10, p11 (structs lat, lon, on one turn)."""
    corners = [(dy, dx) for dy in (0, 1) for dx in (0, 1)]
    at = F.struct(F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    part = F.explode(F.array(*[F.struct((F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.lit(2 * dy + dx).alias("k")) for dy, dx in corners]))
    sides = nodes.where("lat is not null and lon is not null").select(at.alias("p"), part.alias("q"))
    names = [f"p{dy}{dx}" for dy, dx in corners]
    whole = sides.groupBy("q.y", "q.x").agg(*[F.max(F.when(F.col("q.k") == k, F.col("p"))).alias(n) for k, n in enumerate(names)]).dropna(subset=names)
    first = F.col("p00.lon")
    return whole.select("y", "x", "p00", *[F.struct(F.col(f"{n}.lat").alias("lat"), near(F.col(f"{n}.lon"), first).alias("lon")).alias(n) for n in names[1:]])


def boxed(df: DataFrame, points: list[Column]) -> DataFrame:
    """Adds the bounding box of these points: south, north, west, east."""
    lats, lons = [p["lat"] for p in points], [p["lon"] for p in points]
    return df.withColumns({"south": F.least(*lats), "north": F.greatest(*lats), "west": F.least(*lons), "east": F.greatest(*lons)})


def bin_widths(*boxes: DataFrame) -> tuple[float, int]:
    """Height of a bin, and how many bins make a turn: about twice the mean box."""
    high, wide = 0.0, 0.0
    for table in boxes:
        r = table.agg(F.avg(F.col("north") - F.col("south")).alias("high"), F.avg(F.col("east") - F.col("west")).alias("wide")).first()
        high, wide = max(high, r["high"] or 0.0), max(wide, r["wide"] or 0.0)
    return 2 * high or 1.0, max(1, ceil(TURN / (2 * wide or 1.0)))


def dealt(boxes: DataFrame, height: float, turn: int) -> DataFrame:
    """A row per bin that a box touches: bin_y, bin_x (on the circle)."""
    row = lambda c: F.floor(F.col(c) / F.lit(height)).cast("long")
    column = lambda c: F.floor(F.col(c) * F.lit(turn / TURN)).cast("long")
    last = F.least(column("east"), column("west") + (turn - 1))  # a box all around meets each bin once
    rows = boxes.withColumn("bin_y", F.explode(F.sequence(row("south"), row("north"))))
    return rows.withColumn("_c", F.explode(F.sequence(column("west"), last))).withColumn("bin_x", F.pmod(F.col("_c"), F.lit(turn))).drop("_c")


# ---------------------------------------------------------------------------- bilinear


def let(value: Column, use) -> Column:
    """use(value), where the value is computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def inverse_bilinear(lat: Column, lon: Column) -> Column:
    """Place (t, s) of a point in its row's quad, along y and x; NULL outside."""

    def gap(p: str, q: str) -> Column:
        return F.struct((F.col(f"{p}.lon") - F.col(f"{q}.lon")).alias("u"), (F.col(f"{p}.lat") - F.col(f"{q}.lat")).alias("v"))

    def cross(p: Column, q: Column) -> Column:
        return p["u"] * q["v"] - p["v"] * q["u"]

    to = F.struct((near(lon, F.col("p00.lon")) - F.col("p00.lon")).alias("u"), (lat - F.col("p00.lat")).alias("v"))
    sides = F.struct(gap("p01", "p00").alias("a"), gap("p10", "p00").alias("b"), gap("p11", "p10").alias("d"), to.alias("q"))

    def solved(g: Column) -> Column:
        c = F.struct((g["d"]["u"] - g["a"]["u"]).alias("u"), (g["d"]["v"] - g["a"]["v"]).alias("v"))
        return let(c, lambda c: roots(g["a"], g["b"], c, g["q"]))

    def roots(a: Column, b: Column, c: Column, q: Column) -> Column:
        # q = s a + t b + s t c, so t solves two t^2 + one t + none = 0
        terms = F.struct((-cross(b, c)).alias("two"), (cross(q, c) - cross(b, a)).alias("one"), cross(q, a).alias("none"))

        def half(k: Column) -> Column:
            root = F.sqrt(F.greatest(k["one"] * k["one"] - 4 * k["two"] * k["none"], F.lit(0.0)))
            return F.struct(k["two"].alias("two"), k["none"].alias("none"), (F.lit(-0.5) * (k["one"] + F.when(k["one"] < 0, -root).otherwise(root))).alias("half"))

        def place(t: Column) -> Column:
            along = F.struct((a["u"] + t * c["u"]).alias("u"), (a["v"] + t * c["v"]).alias("v"))
            flat = lambda w: F.try_divide(q["u"] - t * b["u"], w["u"])
            steep = lambda w: F.try_divide(q["v"] - t * b["v"], w["v"])
            s = let(along, lambda w: F.when(F.abs(w["u"]) >= F.abs(w["v"]), flat(w)).otherwise(steep(w)))
            return F.struct(t.alias("t"), s.alias("s"))

        both = let(let(terms, half), lambda k: F.transform(F.array(F.try_divide(k["none"], k["half"]), F.try_divide(k["half"], k["two"])), place))
        return F.get(F.filter(both, lambda r: r["t"].between(-EDGE, 1 + EDGE) & r["s"].between(-EDGE, 1 + EDGE)), F.lit(0))

    clamp = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    return let(let(sides, solved), lambda r: F.when(r.isNotNull(), F.struct(clamp(r["t"]).alias("t"), clamp(r["s"]).alias("s"))))


def bilinear_weights(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """Weights of the four nodes around every target point; `targets` has dst_y, dst_x, lat, lon.

    A point on the border of quads takes the first one. A target outside the grid keeps some node with
    a NULL weight, so that its result is missing rather than dropped.
    """
    names = ["p00", "p01", "p10", "p11"]
    table = stored(boxed(quads(nodes), [F.col(n) for n in names]), "quads")
    height, turn = bin_widths(table)
    points = targets.select("dst_y", "dst_x", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    points = points.withColumns({"bin_y": F.floor(F.col("lat") / F.lit(height)), "bin_x": F.pmod(F.floor(F.col("lon") * F.lit(turn / TURN)), F.lit(turn))})
    met = points.join(dealt(table, height, turn), ["bin_y", "bin_x"]).withColumn("at", inverse_bilinear(F.col("lat"), F.col("lon")))
    found = met.where("at is not null").groupBy("dst_y", "dst_x").agg(F.min(F.struct("y", "x", "at")).alias("q"))
    t, s, one = F.col("q.at.t"), F.col("q.at.s"), F.lit(1.0)
    corner = lambda dy, dx, w: F.struct((F.col("q.y") + dy).alias("src_y"), (F.col("q.x") + dx).alias("src_x"), w.alias("w"))
    four = F.array(corner(0, 0, (one - t) * (one - s)), corner(0, 1, (one - t) * s), corner(1, 0, t * (one - s)), corner(1, 1, t * s))
    inside = found.select("dst_y", "dst_x", F.explode(four).alias("e")).select("e.src_y", "e.src_x", "dst_y", "dst_x", "e.w")
    some = nodes.select("y", "x").distinct().orderBy(F.xxhash64("y", "x"), "y", "x").limit(OUTSIDE)  # shares for the targets outside
    anchors = some.agg(F.array_sort(F.collect_list(F.struct("y", "x"))).alias("a")).scalar()
    lost = targets.select("dst_y", "dst_x").join(found.select("dst_y", "dst_x"), ["dst_y", "dst_x"], "left_anti").withColumn("a", anchors)
    lost = lost.withColumn("e", F.get("a", F.pmod(F.xxhash64("dst_y", "dst_x"), F.greatest(F.size("a"), F.lit(1))).cast("int")))
    lost = lost.select(F.col("e.y").alias("src_y"), F.col("e.x").alias("src_x"), "dst_y", "dst_x", F.lit(None).cast("double").alias("w"))
    return inside.where("w > 0").unionByName(lost)


def regrid_curvilinear(cube: DataFrame, weights: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Bilinear remap of a cube (keys, y, x, values) by a weight table; missing when any corner with weight is."""
    whole = stored(weights, "weights")
    need = whole.groupBy("dst_y", "dst_x").agg(F.count(F.lit(1)).alias("_n"))
    table = stored(whole.join(need, ["dst_y", "dst_x"]), "weights")
    placed = cube.join(table.withColumnsRenamed({"src_y": "y", "src_x": "x"}), ["y", "x"])
    part = lambda v: F.col("w") * F.col(v)
    return placed.groupBy(*keys, F.col("dst_y").alias("y"), F.col("dst_x").alias("x")).agg(
        *[F.when(F.count(part(v)) == F.max("_n"), F.sum(part(v))).alias(v) for v in values]
    )


# ---------------------------------------------------------------------------- conservative


def with_rim(nodes: DataFrame) -> DataFrame:
    """The grid with one more node on every side, carried on from the last two."""
    out = nodes.select("y", "x", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    for axis, other in (("y", "x"), ("x", "y")):
        ends = out.agg(F.min(axis).alias("low"), F.max(axis).alias("high")).first()
        if ends["low"] is None or ends["low"] == ends["high"]:
            continue
        for last, step in ((ends["low"], 1), (ends["high"], -1)):
            pick = lambda at, c: F.max(F.when(F.col(axis) == at, F.col(c)))  # noqa: B023, E731
            two = out.where(F.col(axis).isin(last, last + step)).groupBy(other).agg(*[pick(at, c).alias(f"{c}{k}") for k, at in enumerate((last, last + step)) for c in ("lat", "lon")])
            rim = two.select(
                F.lit(last - step).cast(nodes.schema[axis].dataType).alias(axis), other,
                (2 * F.col("lat0") - F.col("lat1")).alias("lat"), (2 * F.col("lon0") - near(F.col("lon1"), F.col("lon0"))).alias("lon"),
            )
            out = out.unionByName(rim.dropna())
    return out


def cells(nodes: DataFrame) -> DataFrame:
    """A cell per node, its corners in the middle of the four nodes around them: y, x, corners (array of lat, lon)."""
    middle = F.struct(
        ((F.col("p00.lat") + F.col("p01.lat") + F.col("p10.lat") + F.col("p11.lat")) / 4).alias("lat"),
        ((F.col("p00.lon") + F.col("p01.lon") + F.col("p10.lon") + F.col("p11.lon")) / 4).alias("lon"),
    )
    corners = quads(with_rim(nodes)).select("y", "x", middle.alias("p"))
    around = [(0, 0), (0, 1), (1, 1), (1, 0)]  # of the cell, in its own order
    part = F.explode(F.array(*[F.struct((F.col("y") + 1 - dy).alias("y"), (F.col("x") + 1 - dx).alias("x"), F.lit(k).alias("k")) for k, (dy, dx) in enumerate(around)]))
    sides = corners.select("p", part.alias("q"))
    names = [f"c{k}" for k in range(4)]
    whole = sides.groupBy("q.y", "q.x").agg(*[F.max(F.when(F.col("q.k") == k, F.col("p"))).alias(n) for k, n in enumerate(names)]).dropna(subset=names)
    return whole.join(nodes.select("y", "x"), ["y", "x"], "left_semi").select("y", "x", F.array(*names).alias("corners"))


def flattened(corners: Column) -> Column:
    """Corners on one turn, in equal-area coordinates (u: longitude, v: sine of latitude in the same unit), anticlockwise."""
    first = corners[0]["lon"]
    flat = F.transform(
        corners, lambda p: F.struct(near(p["lon"], first).alias("u"), (F.degrees(F.sin(F.radians(F.least(F.greatest(p["lat"], F.lit(-90.0)), F.lit(90.0)))))).alias("v"))
    )
    return F.when(signed_area(flat) < 0, F.reverse(flat)).otherwise(flat)


def following(points: Column, i: Column) -> Column:
    return F.get(points, F.pmod(i + 1, F.size(points)).cast("int"))


def signed_area(points: Column) -> Column:
    doubled = F.transform(points, lambda p, i: p["u"] * following(points, i)["v"] - following(points, i)["u"] * p["v"])
    return F.aggregate(doubled, F.lit(0.0), lambda a, b: a + b) / 2


def clipped(polygon: Column, frame: Column) -> Column:
    """The part of a polygon inside an anticlockwise convex one: a fold over the frame's edges."""
    edges = F.transform(frame, lambda p, i: F.struct(p.alias("a"), following(frame, i).alias("b")))

    def cut(points: Column, edge: Column) -> Column:
        a, b = edge["a"], edge["b"]
        side = lambda p: (b["u"] - a["u"]) * (p["v"] - a["v"]) - (b["v"] - a["v"]) * (p["u"] - a["u"])

        def kept(p: Column, i: Column) -> Column:
            q = following(points, i)
            x, y = side(p), side(q)
            share = x / (x - y)
            meet = F.struct((p["u"] + share * (q["u"] - p["u"])).alias("u"), (p["v"] + share * (q["v"] - p["v"])).alias("v"))
            nothing = F.slice(F.array(p), 1, 0)
            return F.when((x >= 0) & (y >= 0), F.array(q)).when(x >= 0, F.array(meet)).when(y >= 0, F.array(meet, q)).otherwise(nothing)

        return F.flatten(F.transform(points, kept))

    return F.aggregate(edges, polygon, cut)


def conservative_weights(source: DataFrame, target: DataFrame) -> DataFrame:
    """Overlap areas of source cells (y, x, corners) and target cells (dst_y, dst_x, corners), convex both.

    Edges are straight in equal-area coordinates. A pair that meets in several bins counts in the one
    that holds the south-west corner of both boxes' overlap.
    """

    def flat(df: DataFrame, ids: list[str], name: str) -> DataFrame:
        rows = df.select(*ids, flattened(F.col("corners")).alias(name))
        lat, lon = F.transform(name, lambda p: p["v"]), F.transform(name, lambda p: p["u"])
        return rows.withColumns({"south": F.array_min(lat), "north": F.array_max(lat), "west": F.array_min(lon), "east": F.array_max(lon)})

    boxes = ["south", "north", "west", "east"]
    ours = stored(flat(source.select(F.col("y").alias("src_y"), F.col("x").alias("src_x"), "corners"), ["src_y", "src_x"], "one"), "cells")
    theirs = stored(flat(target, ["dst_y", "dst_x"], "two"), "cells")
    height, turn = bin_widths(ours, theirs)
    left = dealt(ours, height, turn).withColumnsRenamed({c: f"s_{c}" for c in boxes})
    met = left.join(dealt(theirs, height, turn), ["bin_y", "bin_x"])
    shift = F.lit(TURN) * F.round((F.col("s_west") + F.col("s_east") - F.col("west") - F.col("east")) / F.lit(2 * TURN))
    met = met.withColumn("shift", shift)
    south, west = F.greatest("south", "s_south"), F.greatest(F.col("west"), F.col("s_west") - F.col("shift"))
    home = (F.floor(south / F.lit(height)) == F.col("bin_y")) & (F.pmod(F.floor(west * F.lit(turn / TURN)), F.lit(turn)) == F.col("bin_x"))
    touch = (south < F.least("north", "s_north")) & (west < F.least(F.col("east"), F.col("s_east") - F.col("shift")))
    moved = F.transform("one", lambda p: F.struct((p["u"] - F.col("shift")).alias("u"), p["v"].alias("v")))
    areas = met.where(home & touch).select("src_y", "src_x", "dst_y", "dst_x", signed_area(clipped(moved, F.col("two"))).alias("w"))
    return areas.where("w > 0")


def regrid_curvilinear_conservative(cube: DataFrame, weights: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Area-weighted remap; missing source values carry no weight."""
    return regrid_weights(cube, stored(weights, "weights"), keys, values)
