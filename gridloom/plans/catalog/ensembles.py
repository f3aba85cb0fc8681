"""Ensemble scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import aggregate, align, ensemble
from gridloom.plans.catalog.aggregation import box_sql
from gridloom.plans.catalog.base import ENS, MONTHLY_TRUTH, d, query, r, season
from gridloom.sources import tables
from gridloom.sources.workspace import stored

_JOINED = f"""{MONTHLY_TRUTH}, {ENS},
  j as (select time, y, x, member, pred, truth from ens join obs using (time, y, x) where truth is not null)"""
_CRPS = _JOINED + """,
  pw as (select a.time, a.y, a.x, avg(abs(a.pred - b.pred)) as d from j a join j b using (time, y, x) group by 1, 2, 3),
  er as (select time, y, x, avg(abs(pred - truth)) as e from j group by 1, 2, 3),
  c as (select time, y, x, e - d / 2 as crps from er join pw using (time, y, x))"""


@query("ens_mean", f"with {ENS} select {d('time')} as time, y, x, {r('avg(pred)')} as pred from ens group by time, y, x")
def ens_mean(spark, sf):
    return ensemble.ens_mean(tables.ens(spark, sf))


@query("ens_median", f"with {ENS} select {d('time')} as time, y, x, {r('median(pred)')} as pred from ens group by time, y, x")
def ens_median(spark, sf):
    return ensemble.ens_median(tables.ens(spark, sf))


def _band_sql(probs) -> str:
    cols = ", ".join(f"{r(f'quantile_cont(v, {p})')} as q{round(p * 100)}" for p in probs)
    return f"""with {ENS}, a as (select time, member, sum(cos(radians(43.0 + y)) * pred) / sum(cos(radians(43.0 + y))) as v
        from ens group by 1, 2),
      m as (select month(time) as month, member, avg(v) as v from a group by 1, 2)
      select cast(month as int) as month, {cols} from m group by month"""


@query("ens_quantile_band", _band_sql((0.25, 0.5, 0.75)))
def ens_quantile_band(spark, sf):
    return ensemble.ens_quantile_band(tables.ens(spark, sf), align.cos_latitude(F.col("y") + 43.0))


@query("ens_quantile_band_wide", _band_sql((0.1, 0.5, 0.9)))
def ens_quantile_band_wide(spark, sf):
    weight = align.cos_latitude(F.col("y") + 43.0)
    return ensemble.ens_quantile_band(tables.ens(spark, sf), weight, probs=(0.1, 0.5, 0.9))


def _scores(spark, sf):
    return ensemble.crps(stored(tables.ens(spark, sf)), stored(tables.monthly_truth(spark, sf)))


@query("crps", f"with {_CRPS} select {d('time')} as time, y, x, {r('crps')} as crps from c")
def crps(spark, sf):
    return _scores(spark, sf)


@query("crps_time_mean", f"with {_CRPS} select y, x, {r('avg(crps)')} as crps from c group by y, x")
def crps_time_mean(spark, sf):
    return ensemble.crps_mean(_scores(spark, sf), ["y", "x"])


@query("crps_space_mean", f"with {_CRPS} select {d('time')} as time, {r('avg(crps)')} as crps from c group by time")
def crps_space_mean(spark, sf):
    return ensemble.crps_mean(_scores(spark, sf), ["time"])


@query("crps_season", f"with {_CRPS} select y, x, {season()} as season, {r('avg(crps)')} as crps from c group by all")
def crps_season(spark, sf):
    return ensemble.crps_season(_scores(spark, sf))


@query(
    "crps_box_month",
    box_sql(
        _CRPS + ", s as (select time, avg(crps) as value from c group by 1), "
        "long as (select cast(month(time) as int) as month, value from s)",
        "month",
    ),
)
def crps_box_month(spark, sf):
    series = ensemble.crps_mean(_scores(spark, sf), ["time"])
    months = series.select(F.month("time").alias("month"), F.col("crps").alias("value"))
    return aggregate.box_stats(months, ["month"], "value")


@query(
    "spread_error_cell",
    f"""with {_JOINED}, s1 as (select time, y, x, stddev_pop(pred) as s from ens group by 1, 2, 3),
      s as (select y, x, avg(s) as spread from s1 group by 1, 2),
      e1 as (select y, x, member, sqrt(avg((pred - truth) * (pred - truth))) as e from j group by 1, 2, 3),
      e as (select y, x, avg(e) as rmse from e1 group by 1, 2)
      select y, x, {r('spread')} as spread, {r('rmse')} as rmse, {r('spread / nullif(rmse, 0)')} as ratio
      from s join e using (y, x)""",
)
def spread_error_cell(spark, sf):
    return ensemble.spread_error_cell(stored(tables.ens(spark, sf)), stored(tables.monthly_truth(spark, sf)))


def _spread_sql(error: str) -> str:
    return f"""with {MONTHLY_TRUTH}, {ENS}, s as (select time, y, x, stddev_pop(pred) as spread, avg(pred) as mean
        from ens group by 1, 2, 3),
      e as (select {error} as error from s join obs using (time, y, x))
      select y, x, {season()} as season, {r('avg(spread / nullif(error, 0))')} as ratio from s, e group by all"""


_MSE = "avg((truth - mean) * (truth - mean))"


@query("spread_error_mse", _spread_sql(_MSE))
def spread_error_mse(spark, sf):
    return ensemble.spread_error_season(stored(tables.ens(spark, sf)), stored(tables.monthly_truth(spark, sf)))


@query("spread_error_rmse", _spread_sql(f"sqrt({_MSE})"))
def spread_error_rmse(spark, sf):
    return ensemble.spread_error_season(
        stored(tables.ens(spark, sf)), stored(tables.monthly_truth(spark, sf)), root=True
    )


@query(
    "rps",
    f"""with {_JOINED}, s as (select time, y, x,
        pow(avg(cast(pred < 20 as int)) - max(cast(truth < 20 as int)), 2)
        + pow(avg(cast(pred < 30 as int)) - max(cast(truth < 30 as int)), 2) as s from j group by 1, 2, 3)
      select y, x, {r('avg(s)')} as rps from s group by y, x""",
)
def rps(spark, sf):
    return ensemble.rps(tables.ens(spark, sf), tables.monthly_truth(spark, sf), [20.0, 30.0])


@query(
    "rps_terciles",
    f"""with {_JOINED}, q as (select y, x, round(quantile_cont(round(truth, 9), 1/3), 9) as a,
        round(quantile_cont(round(truth, 9), 2/3), 9) as b from obs group by 1, 2),
      s as (select time, y, x, pow(avg(cast(pred < a as int)) - max(cast(round(truth, 9) < a as int)), 2)
        + pow(avg(cast(pred < b as int)) - max(cast(round(truth, 9) < b as int)), 2) as s from j join q using (y, x) group by 1, 2, 3)
      select y, x, {r('avg(s)')} as rps from s group by y, x""",
)
def rps_terciles(spark, sf):
    return ensemble.rps_terciles(stored(tables.ens(spark, sf)), stored(tables.monthly_truth(spark, sf)))


@query(
    "rank_histogram",
    f"""with {_JOINED}, k as (select cast(1 + count(*) filter (pred < truth) as int) as rank from j group by time, y, x)
      select rank, count(*) as n from k group by rank""",
)
def rank_histogram(spark, sf):
    return ensemble.rank_histogram(tables.ens(spark, sf), tables.monthly_truth(spark, sf))
