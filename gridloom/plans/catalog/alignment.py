"""Joins of cubes and series."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import align
from gridloom.plans.catalog.base import BOOKED, DEM, PAIR, d, query, r
from gridloom.sources import tables
from gridloom.sources.workspace import stored

KEYS = ["time", "y", "x"]


def _truth(spark, sf):
    cube = tables.pair(spark, sf)
    return cube.filter(F.col("truth").isNotNull()).select(*KEYS, "truth")


@query(
    "merge_vars",
    f"""with {PAIR}, {BOOKED}, t as (select time, y, x, truth from pair where truth is not null)
      select {d('time')} as time, y, x, {r('truth')} as truth, {r('model')} as model
      from t full outer join booked using (time, y, x)""",
)
def merge_vars(spark, sf):
    return align.merge_vars(_truth(spark, sf), tables.booked(spark, sf), KEYS)


@query(
    "pair_truth_pred",
    f"""with {PAIR}, {BOOKED}
      select {d('time')} as time, y, x, {r('truth')} as truth, {r('model')} as model
      from pair join booked using (time, y, x) where truth is not null""",
)
def pair_truth_pred(spark, sf):
    return align.pair_on_keys(_truth(spark, sf), tables.booked(spark, sf), KEYS)


@query(
    "pair_on_grid_index",
    f"""with {DEM}, f as (select y * 0.01 + 46 as y, x * 0.01 + 11 as x, elevation + 1 as model from dem),
      a as (select *, dense_rank() over (order by y) as iy, dense_rank() over (order by x) as ix from dem),
      b as (select *, dense_rank() over (order by y) as iy, dense_rank() over (order by x) as ix from f)
      select a.y, a.x, {r('elevation')} as elevation, {r('model')} as model from a join b using (iy, ix)""",
)
def pair_on_grid_index(spark, sf):
    dem = tables.dem(spark, sf)
    moved = dem.select(
        (F.col("y") * 0.01 + 46).alias("y"),
        (F.col("x") * 0.01 + 11).alias("x"),
        (F.col("elevation") + 1).alias("model"),
    )
    return align.pair_on_grid_index(dem, moved, [])


@query(
    "three_way",
    f"""with {PAIR}, {BOOKED}
      select {d('time')} as time, y, x, {r('truth')} as truth, {r('model')} as model, {r('refe')} as refe
      from pair join booked using (time, y, x) where truth is not null""",
)
def three_way(spark, sf):
    reference = tables.pair(spark, sf).select(*KEYS, "refe")
    return align.three_way(_truth(spark, sf), tables.booked(spark, sf), reference, KEYS)


@query(
    "merge_area_series",
    f"""with {PAIR}, {BOOKED}, a as (select time, avg(truth) as truth, avg(pred) as pred from pair group by 1),
      b as (select time, avg(model) as model from booked group by 1)
      select {d('time')} as time, {r('truth')} as truth, {r('pred')} as pred, {r('model')} as model
      from a join b using (time)""",
)
def merge_area_series(spark, sf):
    cube = stored(tables.pair(spark, sf))
    series = [
        align.area_mean(cube, ["truth"]),
        align.area_mean(cube, ["pred"]),
        align.area_mean(tables.booked(spark, sf), ["model"]),
    ]
    return align.merge_area_series(series)


@query(
    "stack_datasets",
    f"""with {PAIR}, m as (select y, x, avg(truth) as t, avg(pred) as p from pair group by 1, 2)
      select y, x, {r('t')} as value, cast(0 as int) as number from m
      union all select y, x, {r('p')}, 1 from m union all select y, x, {r('p - t')}, 2 from m""",
)
def stack_datasets(spark, sf):
    means = tables.pair(spark, sf).groupBy("y", "x").agg(
        F.avg("truth").alias("t"), F.avg("pred").alias("p")
    )
    maps = [F.col("t"), F.col("p"), F.col("p") - F.col("t")]
    return align.stack_datasets([means.select("y", "x", m.alias("value")) for m in maps])


@query(
    "area_mean",
    f"with {PAIR} select {d('time')} as time, {r('avg(truth)')} as truth, {r('avg(pred)')} as pred from pair group by time",
)
def area_mean(spark, sf):
    return align.area_mean(tables.pair(spark, sf), ["truth", "pred"])


@query(
    "area_mean_coslat",
    f"""with {PAIR}, w as (select *, cos(radians(43.0 + y)) as w from pair)
      select {d('time')} as time, {r('sum(w * truth) / nullif(sum(w) filter (truth is not null), 0)')} as truth,
        {r('sum(w * pred) / sum(w)')} as pred from w group by time""",
)
def area_mean_coslat(spark, sf):
    weight = align.cos_latitude(F.col("y") + 43.0)
    return align.area_mean_weighted(tables.pair(spark, sf), ["truth", "pred"], weight)
