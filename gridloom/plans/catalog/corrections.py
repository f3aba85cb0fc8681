"""Bias correction."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import bias
from gridloom.plans.catalog.base import PAIR, d, query, r
from gridloom.sources import tables
from gridloom.sources.workspace import stored

_PARTS = PAIR + """,
o as (select y, x, truth as v, row_number() over (partition by y, x order by truth) - 1 as k
  from pair where time < date '1999-01-01' and truth is not null),
m as (select y, x, pred as v, row_number() over (partition by y, x order by pred) - 1 as k
  from pair where time < date '1999-01-01'),
stats as (select y, x, nm, no, qm, qo from
  (select y, x, count(*) as nm, quantile_cont(v, [0.25, 0.5, 0.75]) as qm from m group by 1, 2)
  join (select y, x, count(*) as no, quantile_cont(v, [0.25, 0.5, 0.75]) as qo from o group by 1, 2) using (y, x)),
u as (select time, y, x, pred as v, 0 as is_mod from pair where time >= date '1999-01-01'
  union all select null, y, x, v, 1 from m),
e as (select *, sum(is_mod) over (partition by y, x order by v) as below from u),
p as (select e.time, e.y, e.x, e.v, below / nm * (no - 1) as ho, below / nm * (nm - 1) as hm, qm, qo
  from e join stats using (y, x) where is_mod = 0),
l as (select p.time, p.y, p.x, p.v, qm, qo,
    a.v + coalesce((b.v - a.v) * (ho - floor(ho)), 0) as xo, c.v + coalesce((f.v - c.v) * (hm - floor(hm)), 0) as xm
  from p join o a on a.y = p.y and a.x = p.x and a.k = floor(ho)
  left join o b on b.y = p.y and b.x = p.x and b.k = floor(ho) + 1
  join m c on c.y = p.y and c.x = p.x and c.k = floor(hm)
  left join m f on f.y = p.y and f.x = p.x and f.k = floor(hm) + 1)"""


def _frames(spark, sf):
    calib = stored(tables.pair(spark, sf, end="1999-01-01"))
    obs = calib.select("y", "x", F.col("truth").alias("value"))
    mod = calib.select("y", "x", F.col("pred").alias("value"))
    later = stored(tables.pair(spark, sf, start="1999-01-01"))
    return obs, mod, later.select("time", "y", "x", F.col("pred").alias("value"))


@query(
    "qm_basic",
    f"with {_PARTS} select {d('time')} as time, y, x, {r('v')} as value, {r('v + xo - xm')} as corrected from l",
)
def qm_basic(spark, sf):
    return bias.quantile_map(*_frames(spark, sf), "value")


@query(
    "qm_modified",
    f"""with {_PARTS}, s as (select *, qo[2] - qm[2] as mid, qo[2] / nullif(qm[2], 0) as g,
        (qo[3] - qo[1]) / nullif(qm[3] - qm[1], 0) as f from l)
      select {d('time')} as time, y, x, {r('v')} as value, {r('v + g * mid + f * (xo - xm - mid)')} as corrected from s""",
)
def qm_modified(spark, sf):
    return bias.quantile_map(*_frames(spark, sf), "value", modified=True)
