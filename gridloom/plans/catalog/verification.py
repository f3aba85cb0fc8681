"""Deterministic scores."""

from __future__ import annotations

from gridloom.operators import align, verification as V
from gridloom.plans.catalog.base import (
    BOOKED,
    ENS,
    MONTHLY_TRUTH,
    PAIR,
    RAIN,
    query,
    r,
    ratio,
    relative,
    season,
)
from gridloom.sources import tables
from gridloom.sources.workspace import stored

KEYS = ["time", "y", "x"]


def r2_sql(t: str = "t", p: str = "p") -> str:
    return f"1 - sum(({t} - {p}) * ({t} - {p})) / nullif(var_pop({t}) * count({t}), 0)"


_MASKED = PAIR + """,
masked as (select time, y, x, truth as t, case when truth is not null then pred end as p from pair)"""
_MONTHLY = _MASKED + """,
mm as (select y, x, date_trunc('month', time) as month, avg(t) as t, avg(p) as p from masked group by 1, 2, 3
  having avg(t) is not null)"""
_ANOM = _MASKED + """,
an as (select y, x, t - avg(t) over (partition by y, x, month(time)) as t,
    p - avg(p) over (partition by y, x, month(time)) as p from masked where t is not null)"""


@query("r2_pooled_monthly", f"with {_MONTHLY} select {r(r2_sql())} as r2 from mm")
def r2_pooled_monthly(spark, sf):
    return V.r2_pooled_monthly(tables.pair(spark, sf).select(*KEYS, "truth", "pred"))


@query("r2_pooled_anom", f"with {_ANOM} select {r(r2_sql())} as r2 from an")
def r2_pooled_anom(spark, sf):
    return V.r2_pooled_anomaly(stored(tables.pair(spark, sf).select(*KEYS, "truth", "pred")))


@query(
    "r2_by_cell",
    f"""with {_MONTHLY}, {_ANOM[len(_MASKED) + 2:]}, a as (select y, x, {r2_sql()} as r2_monthly from mm group by 1, 2),
      b as (select y, x, {r2_sql()} as r2_anomaly from an group by 1, 2)
      select y, x, {r('r2_monthly')} as r2_monthly, {r('r2_anomaly')} as r2_anomaly from a join b using (y, x)""",
)
def r2_by_cell(spark, sf):
    return V.r2_by(stored(tables.pair(spark, sf).select(*KEYS, "truth", "pred")), ["y", "x"])


@query(
    "r2_by_member",
    f"""with {MONTHLY_TRUTH}, {ENS}, j as (select time, y, x, member, pred as p, truth as t
        from ens join obs using (time, y, x) where truth is not null),
      an as (select member, t - avg(t) over (partition by y, x, member, month(time)) as t,
        p - avg(p) over (partition by y, x, member, month(time)) as p from j),
      a as (select member, {r2_sql()} as r2_monthly from j group by 1),
      b as (select member, {r2_sql()} as r2_anomaly from an group by 1)
      select member, {r('r2_monthly')} as r2_monthly, {r('r2_anomaly')} as r2_anomaly from a join b using (member)""",
)
def r2_by_member(spark, sf):
    paired = align.pair_on_keys(stored(tables.ens(spark, sf)), stored(tables.monthly_truth(spark, sf)), KEYS)
    return V.r2_by(paired, ["member"])


_YEARS = """ym as (select y, x, year(time) as year, avg(truth) as t, avg(pred) as p from {0} group by 1, 2, 3)"""
_SCORES = f"{r('avg(abs(p - t))')} as mae, {r('sqrt(avg((p - t) * (p - t)))')} as rmse"


@query(
    "skill_yearly_abs",
    f"with {PAIR}, {_YEARS.format('pair')} select {r('avg(p - t)')} as bias, {_SCORES} from ym",
)
def skill_yearly_abs(spark, sf):
    return V.skill_yearly(tables.pair(spark, sf))


@query(
    "skill_yearly_rel",
    f"""with {RAIN}, masked as (select time, y, x, truth, case when truth is not null then pred end as pred from rain),
      {_YEARS.format('masked')} select {r(f"avg({relative('p', 't')})")} as bias, {_SCORES} from ym""",
)
def skill_yearly_rel(spark, sf):
    return V.skill_yearly(V.mask_by_truth(tables.rain(spark, sf), "truth", ["pred"]), relative=True)


@query(
    "pearson_by_year",
    f"with {PAIR}, {_YEARS.format('pair')} select cast(year as int) as year, {r('corr(p, t)')} as r from ym group by year",
)
def pearson_by_year(spark, sf):
    return V.pearson_by_year(tables.pair(spark, sf))


@query(
    "pearson_total",
    f"""with {PAIR}, {_YEARS.format('pair')}, c as (select year, corr(p, t) as r from ym group by 1)
      select {r('(select corr(p, t) from ym)')} as r_pooled, {r('(select avg(r) from c)')} as r_mean""",
)
def pearson_total(spark, sf):
    return V.pearson_total(stored(tables.pair(spark, sf)))


@query(
    "bias_map",
    f"""with {PAIR}, {_YEARS.format('pair')} select y, x, {r('avg(t)')} as truth, {r('avg(p)')} as pred,
      {r('avg(p) - avg(t)')} as bias from ym group by y, x""",
)
def bias_map(spark, sf):
    return V.bias_map(tables.pair(spark, sf))


_OVER = "{r0} as bias, {r1} as bias_min, {r2} as bias_max"


def _over(expression: str) -> str:
    return _OVER.format(
        r0=r(f"avg({expression})"), r1=r(f"min({expression})"), r2=r(f"max({expression})")
    )


_SEASONS = "sm as (select y, x, {1} as season, avg(truth) as t, avg(pred) as p from {0} group by all)"


@query(
    "bias_season",
    f"with {PAIR}, {_SEASONS.format('pair', season())} select season, {_over('p - t')} from sm group by season",
)
def bias_season(spark, sf):
    return V.bias_season(tables.pair(spark, sf))


@query(
    "bias_season_rel",
    f"with {RAIN}, {_SEASONS.format('rain', season())} select season, {_over(relative('p', 't'))} from sm group by season",
)
def bias_season_rel(spark, sf):
    return V.bias_season(tables.rain(spark, sf), relative=True)


_P = "quantile_cont(truth, {0}) as t, quantile_cont(pred, {0}) as p"


@query(
    "extreme_skill",
    f"""with {PAIR}, ym as (select y, x, year(time) as year, {_P.format(0.98)} from pair group by 1, 2, 3)
      select {r('avg(p - t)')} as bias, {_SCORES} from ym""",
)
def extreme_skill(spark, sf):
    return V.extreme_skill(tables.pair(spark, sf), 0.98)


@query(
    "extreme_skill_low",
    f"""with {PAIR}, ym as (select y, x, year(time) as year, {_P.format(0.02)} from pair group by 1, 2, 3)
      select {r('avg(p - t)')} as bias, {_SCORES} from ym""",
)
def extreme_skill_low(spark, sf):
    return V.extreme_skill(tables.pair(spark, sf), 0.02)


@query(
    "extreme_bias_season",
    f"""with {RAIN}, sm as (select y, x, {season()} as season, {_P.format(0.98)} from rain group by all)
      select season, {_over(relative('p', 't'))} from sm group by season""",
)
def extreme_bias_season(spark, sf):
    return V.extreme_bias_season(tables.rain(spark, sf), 0.98)


_WET = RAIN + f""",
s as (select y, x, {season()} as season, truth, pred, truth is not null as ok from rain),
c as (select y, x, unnest(['annual', season]) as period, ok, truth, pred from s),
n as (select y, x, period, count(*) filter (ok) as valid,
    count(*) filter (ok and truth >= 1) as wt, count(*) filter (ok and pred >= 1) as wp,
    coalesce(sum(truth) filter (ok and truth >= 1), 0) as st, coalesce(sum(pred) filter (ok and pred >= 1), 0) as sp
  from c group by 1, 2, 3),
axis as (select period, count(*) as steps from (
  select unnest(['annual', {season()}]) as period from (select distinct time from rain)) group by 1)"""


def _wet_sql(strict: bool) -> str:
    guard = "case when valid = steps then {} end" if strict else "{}"
    t, p = guard.format("100.0 * wt / nullif(valid, 0)"), guard.format("100.0 * wp / nullif(valid, 0)")
    return f"""with {_WET}, f as (select y, x, period, {t} as t, {p} as p from n join axis using (period))
      select y, x, period, {r('t')} as truth, {r('p')} as pred, {r(relative('p', 't'))} as bias from f"""


@query("wet_day_freq", _wet_sql(True))
def wet_day_freq(spark, sf):
    return V.wet_day_freq(stored(tables.rain(spark, sf)))


@query("wet_day_freq_skipna", _wet_sql(False))
def wet_day_freq_skipna(spark, sf):
    return V.wet_day_freq(stored(tables.rain(spark, sf)), skipna=True)


@query(
    "wet_day_intensity",
    f"""with {_WET}, f as (select y, x, {ratio('st', 'wt')} as t, {ratio('sp', 'wp')} as p from n where period = 'annual')
      select y, x, {r('t')} as truth, {r('p')} as pred, {r(relative('p', 't'))} as bias from f""",
)
def wet_day_intensity(spark, sf):
    return V.wet_day_intensity(stored(tables.rain(spark, sf)), skipna=True)


@query(
    "model_vs_reference",
    f"""with {PAIR}, {BOOKED}, j as (select * from pair join booked using (time, y, x)),
      ym as (select y, x, year(time) as year, avg(truth) as t, avg(model) as p, avg(refe) as q from j group by 1, 2, 3),
      long as (select 'model' as product, t, p from ym union all select 'refe', t, q from ym)
      select product, {r('avg(p - t)')} as bias, {_SCORES} from long group by product""",
)
def model_vs_reference(spark, sf):
    cube = stored(tables.pair(spark, sf))
    triple = align.three_way(
        cube.select(*KEYS, "truth"), tables.booked(spark, sf), cube.select(*KEYS, "refe"), KEYS
    )
    return V.model_vs_reference(triple, ["model", "refe"])


def _compare_sql(by: str) -> str:
    cols = ", ".join(f"{r(f'avg({v})')} as {v}" for v in ("truth", "pred", "refe"))
    return f"""with {PAIR}, a as (select time, avg(truth) as truth, avg(pred) as pred, avg(refe) as refe from pair group by 1)
      select cast({by}(time) as int) as {by}, {cols} from a group by {by}(time)"""


@query("compare_series", _compare_sql("month"))
def compare_series(spark, sf):
    return V.compare_series(tables.pair(spark, sf), ["truth", "pred", "refe"], "month")


@query("compare_series_year", _compare_sql("year"))
def compare_series_year(spark, sf):
    return V.compare_series(tables.pair(spark, sf), ["truth", "pred", "refe"], "year")
