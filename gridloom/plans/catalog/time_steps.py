"""Resampling in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import resample
from gridloom.plans.catalog.base import ENS, LEAD, PAIR, SUB, d, query, r
from gridloom.sources import files, tables
from gridloom.sources.workspace import stored

KEYS = ["x", "variable"]

_DENSE = f"""with {SUB}, cells as (select distinct x, variable from sub),
  days as (select cast(unnest(generate_series(cast(min(ts) as date), cast(max(ts) as date),
    interval 1 day)) as date) as time from sub),
  frame as (select * from cells, days),
  rows_ as (select f.x, f.variable, f.time, s.ts, s.value from frame f left join sub s
    on s.x = f.x and s.variable = f.variable and cast(s.ts as date) = f.time)"""


def _daily_sql(expression: str) -> str:
    return f"{_DENSE} select x, variable, {d('time')} as time, {r(expression)} as value from rows_ group by x, variable, time"


@query("daily_mean", _daily_sql("avg(value)"))
def daily_mean(spark, sf):
    return resample.daily_mean(tables.sub(spark, sf), KEYS)


@query("daily_sum_mm", _daily_sql("round(coalesce(sum(value), 0) * 1000, 3)"))
def daily_sum_mm(spark, sf):
    total = resample.daily_sum(tables.sub(spark, sf), KEYS, factor=1000.0)
    return total.withColumn("value", F.round("value", 3))


@query("daily_max", _daily_sql("max(value)"))
def daily_max(spark, sf):
    return resample.daily_max(tables.sub(spark, sf), KEYS)


@query("daily_min", _daily_sql("min(value)"))
def daily_min(spark, sf):
    return resample.daily_min(tables.sub(spark, sf), KEYS)


@query("daily_first", _daily_sql("arg_min(value, ts)"))
def daily_first(spark, sf):
    return resample.daily_first(tables.sub(spark, sf), KEYS)


def _shift_sql(expression: str) -> str:
    return _DENSE.replace("rows_ as (", "moved as (select x, variable, ts, lead(value, 6) over "
        "(partition by x, variable order by ts) as value from sub), rows_ as (").replace(
        "left join sub s", "left join moved s") + (
        f" select x, variable, {d('time')} as time, {r(expression)} as value from rows_ "
        "where time < (select max(time) from days) group by x, variable, time"
    )


@query("shift_then_daily", _shift_sql("coalesce(sum(value), 0)"))
def shift_then_daily(spark, sf):
    return resample.shift_then_daily(tables.sub(spark, sf), KEYS, "sum")


@query("shift_then_daily_mean", _shift_sql("avg(value)"))
def shift_then_daily_mean(spark, sf):
    return resample.shift_then_daily(tables.sub(spark, sf), KEYS, "mean")


@query(
    "daily_shift_one",
    f"""{_DENSE}, daily as (select x, variable, time, arg_min(value, ts) as v from rows_ group by 1, 2, 3)
      select x, variable, {d('time')} as time, {r('v2')} as value from (
        select *, lead(v) over (partition by x, variable order by time) as v2 from daily)
      where time < (select max(time) from days)""",
)
def daily_shift_one(spark, sf):
    return resample.daily_shift_one(tables.sub(spark, sf), KEYS)


@query(
    "monthly_sum",
    f"""with {PAIR}, axis as (select date_trunc('month', time) as month, count(distinct time) as steps
        from pair group by 1),
      sums as (select y, x, date_trunc('month', time) as month, sum(truth) as truth, count(truth) as nt,
        sum(pred) as pred, count(pred) as np from pair group by 1, 2, 3)
      select y, x, {d('month')} as month, {r('case when nt = steps then truth end')} as truth,
        {r('case when np = steps then pred end')} as pred from sums join axis using (month)""",
)
def monthly_sum(spark, sf):
    return resample.monthly_sum(stored(tables.pair(spark, sf)), ["y", "x"], ["truth", "pred"])


@query(
    "monthly_first",
    f"""with {PAIR} select y, x, {d("date_trunc('month', time)")} as month,
      {r('arg_min(truth, time) filter (where truth is not null)')} as truth from pair group by y, x, date_trunc('month', time)""",
)
def monthly_first(spark, sf):
    return resample.monthly_first(tables.pair(spark, sf), ["y", "x"], "truth")


@query(
    "leadtime_stitch",
    f"""with {LEAD} select id, {d('time')} as time, x, {d('init')} as init, {r('value')} as value
      from lead_t where month(time) = month(init) % 12 + 1""",
)
def leadtime_stitch(spark, sf):
    return resample.leadtime_stitch(tables.lead(spark, sf))


@query(
    "hind_fc_concat",
    f"with {ENS} select {d('time')} as time, y, x, member, {r('pred')} as pred from ens",
)
def hind_fc_concat(spark, sf):
    hindcast = tables.ens(spark, sf, end="1999-01-01")
    forecast = tables.ens(spark, sf, start="1999-01-01")
    return files.concat_time(hindcast, forecast)
