"""Regridding, terrain and tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import curvilinear, regrid, terrain
from gridloom.plans.catalog.base import DEM, PAIR, d, query, r
from gridloom.sources import tables
from gridloom.sources.workspace import stored


@query(
    "regrid_bilinear",
    f"""with {DEM} select a.y + 0.5 as y, a.x + 0.25 as x,
      {r('0.375 * a.elevation + 0.125 * b.elevation + 0.375 * c.elevation + 0.125 * e.elevation')} as elevation
      from dem a left join dem b on b.y = a.y and b.x = a.x + 1
      left join dem c on c.y = a.y + 1 and c.x = a.x
      left join dem e on e.y = a.y + 1 and e.x = a.x + 1""",
)
def regrid_bilinear(spark, sf):
    dem = tables.dem(spark, sf)
    ty = dem.select((F.col("y") + 0.5).alias("y"))
    tx = dem.select((F.col("x") + 0.25).alias("x"))
    return regrid.regrid_bilinear(dem, ty, tx, [], ["elevation"])


@query(
    "regrid_bilinear_cube",
    f"""with {PAIR}, t as (select distinct time, y + 0.5 as ty, x + 0.5 as tx, y as y0, x as x0 from (
        select distinct time from pair) a, (select distinct y from pair) b, (select distinct x from pair) c)
      select {d('t.time')} as time, ty as y, tx as x,
        {r("case when count(p.truth) = 4 then sum(p.truth) / 4 end")} as truth
      from t join pair p on p.time = t.time and p.y in (y0, y0 + 1) and p.x in (x0, x0 + 1)
      where ty < 4 and tx < 4 group by t.time, ty, tx""",
)
def regrid_bilinear_cube(spark, sf):
    cube = stored(tables.pair(spark, sf).select("time", "y", "x", "truth"))
    axis = spark.range(4).select((F.col("id") + 0.5).alias("c"))
    ty, tx = axis.select(F.col("c").alias("y")), axis.select(F.col("c").alias("x"))
    return regrid.regrid_bilinear(cube, ty, tx, ["time"], ["truth"])


@query(
    "regrid_conservative",
    f"""with {DEM}, n as (select max(y) + 1 as n from dem),
      yn as (select distinct y, -80.0 + 160.0 * (y + 0.5) / n as node, 160.0 / n as step, n from dem, n),
      sy as (select y, node, node - step / 2 as lo, node + step / 2 as hi from yn),
      ty as (select node as t, -80.0 + 160.0 * (y - 0.5) / n as lo, -80.0 + 160.0 * (y + 1.5) / n as hi
        from yn where y % 2 = 1),
      sx as (select distinct x, x - 0.5 as lo, x + 0.5 as hi from dem),
      tx as (select distinct x as t, x - 1.0 as lo, x + 1.0 as hi from dem where x % 2 = 1),
      wy as (select sy.y, t, sin(radians(least(sy.hi, ty.hi))) - sin(radians(greatest(sy.lo, ty.lo))) as w
        from sy join ty on sy.lo < ty.hi and sy.hi > ty.lo),
      wx as (select sx.x, t, least(sx.hi, tx.hi) - greatest(sx.lo, tx.lo) as w
        from sx join tx on sx.lo < tx.hi and sx.hi > tx.lo)
      select {r('wy.t')} as y, {r('cast(wx.t as double)')} as x,
        {r('sum(wy.w * wx.w * elevation) / sum(wy.w * wx.w)')} as elevation
      from dem join wy on wy.y = dem.y join wx on wx.x = dem.x group by wy.t, wx.t""",
)
def regrid_conservative(spark, sf):
    dem = tables.dem(spark, sf)
    n = dem.agg((F.max("y") + 1).alias("n")).scalar()

    def latitude(row):
        return F.lit(-80.0) + F.lit(160.0) * row / n

    cube = dem.select(latitude(F.col("y") + 0.5).alias("y"), "x", "elevation")
    odd_y = dem.filter("y % 2 = 1").select("y").distinct()
    odd_x = dem.filter("x % 2 = 1").select(F.col("x").cast("double").alias("node")).distinct()
    ty = odd_y.select(
        latitude(F.col("y") + 0.5).alias("node"),
        latitude(F.col("y") - 0.5).alias("lo"),
        latitude(F.col("y") + 1.5).alias("hi"),
    )
    tx = odd_x.select("node", (F.col("node") - 1).alias("lo"), (F.col("node") + 1).alias("hi"))
    return regrid.regrid_conservative(cube, ty, tx, [], ["elevation"], sphere=True, width=10.0)


def _tilted(y, x):
    """Coordinates of a grid that is turned against the parallels."""
    return (0.05 * (0.8 * y + 0.6 * x)).alias("lat"), (0.05 * (0.8 * x - 0.6 * y)).alias("lon")


@query(
    "regrid_curvilinear",
    f"""with {DEM} select a.y + 0.5 as y, a.x + 0.25 as x,
      {r('0.375 * a.elevation + 0.125 * b.elevation + 0.375 * c.elevation + 0.125 * e.elevation')} as elevation
      from dem a left join dem b on b.y = a.y and b.x = a.x + 1
      left join dem c on c.y = a.y + 1 and c.x = a.x
      left join dem e on e.y = a.y + 1 and e.x = a.x + 1""",
)
def regrid_curvilinear(spark, sf):
    """A turned grid is a plane map, so the place of a target in its quad is known."""
    dem = stored(tables.dem(spark, sf))
    y, x = F.col("y") + 0.5, F.col("x") + 0.25
    weights = curvilinear.bilinear_weights(
        dem.select("y", "x", *_tilted(F.col("y"), F.col("x"))), dem.select(y.alias("dst_y"), x.alias("dst_x"), *_tilted(y, x))
    )
    return curvilinear.regrid_curvilinear(dem, weights, [], ["elevation"])


_LATS, _LONS = [25.0, 38.0, 57.0, 75.0], [-14.0, 0.0, 11.0, 26.0]


@query(
    "regrid_curvilinear_conservative",
    f"""with {PAIR}, ty as (select unnest({_LATS[:-1]}) as lo, unnest({_LATS[1:]}) as hi),
      tx as (select unnest({_LONS[:-1]}) as lo, unnest({_LONS[1:]}) as hi),
      wy as (select y, (lo + hi) / 2 as t, sin(radians(least(hi, 35.0 + 10 * y))) - sin(radians(greatest(lo, 25.0 + 10 * y))) as w
        from (select distinct y from pair) join ty on lo < 35.0 + 10 * y and hi > 25.0 + 10 * y),
      wx as (select x, (lo + hi) / 2 as t, least(hi, 8 * x - 6.0) - greatest(lo, 8 * x - 14.0) as w
        from (select distinct x from pair) join tx on lo < 8 * x - 6.0 and hi > 8 * x - 14.0)
      select {d('time')} as time, {r('wy.t')} as y, {r('wx.t')} as x, {r('sum(wy.w * wx.w * pred) / sum(wy.w * wx.w)')} as pred,
        {r('sum(wy.w * wx.w * truth) / sum(case when truth is not null then wy.w * wx.w end)')} as truth
      from pair join wy using (y) join wx using (x) group by time, wy.t, wx.t""",
)
def regrid_curvilinear_conservative(spark, sf):
    cube = stored(tables.pair(spark, sf).select("time", "y", "x", "pred", "truth"))
    nodes = cube.select("y", "x").distinct().select("y", "x", (30.0 + 10 * F.col("y")).alias("lat"), (8.0 * F.col("x") - 10).alias("lon"))
    boxes = [(a, b, c, e) for a, b in zip(_LATS, _LATS[1:], strict=False) for c, e in zip(_LONS, _LONS[1:], strict=False)]
    frames = [((a + b) / 2, (c + e) / 2, [(a, c), (a, e), (b, e), (b, c)]) for a, b, c, e in boxes]
    target = spark.createDataFrame(frames, "dst_y double, dst_x double, corners array<struct<lat:double,lon:double>>")
    weights = curvilinear.conservative_weights(curvilinear.cells(nodes), target)
    return curvilinear.regrid_curvilinear_conservative(cube, weights, ["time"], ["pred", "truth"])


_AROUND = f"""{DEM}, ns as (
    select m.y, m.x, m.elevation as c, (u.elevation is null or l.elevation is null) as rim,
      coalesce(u.elevation, 2 * m.elevation - l.elevation, m.elevation) as n,
      coalesce(l.elevation, 2 * m.elevation - u.elevation, m.elevation) as s
    from dem m left join dem u on u.y = m.y + 1 and u.x = m.x
      left join dem l on l.y = m.y - 1 and l.x = m.x),
  win as (select m.y, m.x, m.c, m.n, m.s,
    coalesce(e.n, case when m.rim then m.n else 2 * m.n - w.n end) as ne,
    coalesce(e.c, case when m.rim then m.c else 2 * m.c - w.c end) as e,
    coalesce(e.s, case when m.rim then m.s else 2 * m.s - w.s end) as se,
    coalesce(w.n, case when m.rim then m.n else 2 * m.n - e.n end) as nw,
    coalesce(w.c, case when m.rim then m.c else 2 * m.c - e.c end) as w,
    coalesce(w.s, case when m.rim then m.s else 2 * m.s - e.s end) as sw
    from ns m left join ns e on e.y = m.y and e.x = m.x + 1 left join ns w on w.y = m.y and w.x = m.x - 1),
  grad as (select y, x, (ne + 2 * e + se) - (nw + 2 * w + sw) as gx,
    (sw + 2 * s + se) - (nw + 2 * n + ne) as gy from win)"""


@query(
    "dem_slope",
    f"with {_AROUND} select y, x, {r('degrees(atan(sqrt(gx * gx + gy * gy) / 8.0))')} as slope from grad",
)
def dem_slope(spark, sf):
    return terrain.dem_slope(tables.dem(spark, sf))


@query(
    "dem_aspect",
    f"""with {_AROUND}, a as (select *, degrees(atan2(gy, -gx)) as turn from grad),
      b as (select *, case when turn > 90 then 450 - turn else 90 - turn end as az from a)
      select y, x, {r("case when gx = 0 and gy = 0 then null when az = 360 then 0.0 else az end")} as aspect from b""",
)
def dem_aspect(spark, sf):
    return terrain.dem_aspect(tables.dem(spark, sf))


@query(
    "static_broadcast",
    f"""with {PAIR}, {DEM} select {d('time')} as time, y, x, {r('pred')} as pred, {r('elevation')} as elevation
      from pair left join dem using (y, x)""",
)
def static_broadcast(spark, sf):
    cube = tables.pair(spark, sf).select("time", "y", "x", "pred")
    return terrain.static_broadcast(cube, tables.dem(spark, sf))


@query(
    "tile_id",
    f"""with {DEM}, shape as (select max(y) + 1 as h, max(x) + 1 as w from dem),
      p as (select h, w, cast((16 - h % 16) % 16 as int) as ey, cast((16 - w % 16) % 16 as int) as ex from shape),
      rows_ as (select unnest(generate_series(0, h + ey - 1)) as "row" from p),
      cols_ as (select unnest(generate_series(0, w + ex - 1)) as col from p)
      select cast(("row" // 16) * ((w + ex) // 16) + col // 16 as bigint) as tile,
        cast("row" % 16 as bigint) as "row", cast(col % 16 as bigint) as col,
        {r('coalesce(elevation, 0.0)')} as elevation
      from rows_, cols_, p left join dem on dem.y = "row" - ey // 2 and dem.x = col - ex // 2""",
)
def tile_id(spark, sf):
    return terrain.tile_id(tables.dem(spark, sf), "elevation", 16, pad=True)


@query(
    "dem_histogram",
    f"""with {DEM}, e as (select min(elevation) as lo, max(elevation) as hi from dem),
      b as (select unnest(generate_series(0, 3)) as bin),
      c as (select least(floor((elevation - lo) / ((hi - lo) / 4)), 3) as bin, count(*) as n from dem, e group by 1)
      select cast(b.bin as int) as bin, {r('lo + (hi - lo) / 4 * b.bin')} as lo,
        {r('lo + (hi - lo) / 4 * (b.bin + 1)')} as hi, coalesce(n, 0) as n
      from b cross join e left join c on c.bin = b.bin""",
)
def dem_histogram(spark, sf):
    return terrain.histogram(tables.dem(spark, sf), "elevation", 4)


@query(
    "elevation_bands",
    f"""with {DEM}, q as (select {", ".join(f"quantile_cont(elevation, {p}) as q{int(p * 100)}" for p in (0.1, 0.25, 0.5, 0.75, 0.9))}
        from dem)
      select y, x, {r('elevation')} as elevation, {r('q10')} as q10, {r('q25')} as q25, {r('q50')} as q50,
        {r('q75')} as q75, {r('q90')} as q90, cast(elevation < q10 as int) as below,
        cast(elevation > q90 as int) as above from dem, q""",
)
def elevation_bands(spark, sf):
    return terrain.elevation_bands(tables.dem(spark, sf))
