"""Splitting and sampling."""

from __future__ import annotations

from gridloom.operators import splitting
from gridloom.plans.catalog.base import PAIR, RAIN, d, query, r
from gridloom.sources import tables
from gridloom.sources.workspace import stored

KEYS = ["time", "y", "x"]


def _cube(spark, sf):
    return stored(tables.pair(spark, sf).select(*KEYS, "truth", "pred"))


_HEAD = f"{d('time')} as time, y, x, {r('truth')} as truth, {r('pred')} as pred"
_DAY = "cast(time as varchar)"


@query(
    "split_period",
    f"""with {PAIR} select {_HEAD}, case when time <= date '1998-12-31' then 'calibration' else 'validation' end as part from pair""",
)
def split_period(spark, sf):
    cube = tables.pair(spark, sf).select(*KEYS, "truth", "pred")
    return splitting.split_period(cube, "1998-12-31")


@query(
    "split_stratified",
    f"""with {RAIN}, a as (select time, coalesce(cast(avg(truth) >= 4 as int), 0) as wet from rain group by 1),
      k as (select *, row_number() over (partition by wet order by md5('42|' || {_DAY})) as pos,
        count(*) over (partition by wet) as n from a)
      select {d('time')} as time, wet, case when pos <= ceil(n * 0.2::double) then 'valid' else 'train' end as part from k""",
)
def split_stratified(spark, sf):
    return splitting.split_stratified(stored(tables.rain(spark, sf)), "truth", 4.0)


def _axis_sql(order: str) -> str:
    return f"""with {PAIR}, a as (select distinct time from pair),
      k as (select *, row_number() over (order by {order}) as pos, count(*) over () as n from a)
      select {_HEAD}, case when pos <= ceil(n * 0.2::double) then 'valid' else 'train' end as part
      from pair join k using (time)"""


@query("split_random", _axis_sql(f"md5('42|' || {_DAY})"))
def split_random(spark, sf):
    return splitting.split_random(_cube(spark, sf))


@query("split_tail", _axis_sql("time desc"))
def split_tail(spark, sf):
    return splitting.split_tail(_cube(spark, sf))


@query(
    "split_timeseries",
    f"""with {PAIR}, a as (select time, row_number() over (order by time) as pos, count(*) over () as n
        from (select distinct time from pair)),
      f as (select *, unnest(generate_series(1, 10)) as fold, n // 11 as size from a),
      s as (select *, n - (10 - fold + 1) * size as start from f)
      select cast(fold as int) as fold, {d('time')} as time, case when pos <= start then 'train' else 'test' end as part
      from s where pos <= start + size""",
)
def split_timeseries(spark, sf):
    return splitting.split_timeseries(_cube(spark, sf), 10)


def _pick(axis: str, k: int) -> str:
    return f"(select {axis} from (select distinct {axis} from pair) order by md5('42{axis}|' || cast({axis} as varchar)) limit {k})"


@query(
    "sample_cells",
    f"with {PAIR} select {_HEAD} from pair where y in {_pick('y', 3)} and x in {_pick('x', 3)}",
)
def sample_cells(spark, sf):
    return splitting.sample_cells(_cube(spark, sf), 3)


def _draw(axis: str) -> str:
    return f"""d{axis} as (select cast(i as int) as i{axis}, n{axis}.{axis} from (
        select i, floor(cast(('0x' || substr(md5('42{axis}|' || i), 1, 8)) as bigint) / 4294967296.0::double
          * (select count(distinct {axis}) from pair)) + 1 as pos from range(1, 5) t(i)) q
      join (select {axis}, row_number() over (order by {axis}) as pos from (select distinct {axis} from pair)) n{axis} using (pos))"""


@query(
    "sample_cells_repeat",
    f"with {PAIR}, {_draw('y')}, {_draw('x')} select {_HEAD}, iy, ix from pair join dy using (y) join dx using (x)",
)
def sample_cells_repeat(spark, sf):
    return splitting.sample_cells_repeat(_cube(spark, sf), 4)
