"""Aggregation by calendar and space."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import aggregate, terrain, verification
from gridloom.plans.catalog.base import EMB, PAIR, RAIN, query, r, season
from gridloom.sources import tables
from gridloom.sources.workspace import stored

TP = ["truth", "pred"]
_AVG = f"{r('avg(truth)')} as truth, {r('avg(pred)')} as pred"


@query(
    "month_climatology",
    f"with {PAIR} select y, x, cast(month(time) as int) as month, {_AVG} from pair group by y, x, month(time)",
)
def month_climatology(spark, sf):
    return aggregate.month_climatology(tables.pair(spark, sf), TP)


@query(
    "annual_cycle",
    f"""with {PAIR}, m as (select y, x, month(time) as month, avg(truth) as truth, avg(pred) as pred
        from pair group by 1, 2, 3)
      select cast(month as int) as month, {_AVG} from m group by month""",
)
def annual_cycle(spark, sf):
    return aggregate.annual_cycle(tables.pair(spark, sf), TP)


@query(
    "annual_cycle_pooled",
    f"""with {RAIN}, m as (select y, x, date_trunc('month', time) as time,
        coalesce(sum(truth), 0) as truth, coalesce(sum(pred), 0) as pred from rain group by 1, 2, 3)
      select cast(month(time) as int) as month, {_AVG} from m group by month(time)""",
)
def annual_cycle_pooled(spark, sf):
    from gridloom.operators.resample import monthly_sum

    sums = monthly_sum(tables.rain(spark, sf), ["y", "x"], TP, skipna=True)
    return aggregate.annual_cycle(sums.withColumnRenamed("month", "time"), TP, pooled=True)


@query(
    "year_mean",
    f"with {PAIR} select y, x, cast(year(time) as int) as year, {_AVG} from pair group by y, x, year(time)",
)
def year_mean(spark, sf):
    return aggregate.year_mean(tables.pair(spark, sf), TP)


@query(
    "season_mean",
    f"with {PAIR} select y, x, {season()} as season, {_AVG} from pair group by all",
)
def season_mean(spark, sf):
    return aggregate.season_mean(tables.pair(spark, sf), TP)


def _q(p: float) -> str:
    return f"{r(f'quantile_cont(truth, {p})')} as truth, {r(f'quantile_cont(pred, {p})')} as pred"


@query(
    "year_quantile",
    f"with {PAIR} select y, x, cast(year(time) as int) as year, {_q(0.98)} from pair group by y, x, year(time)",
)
def year_quantile(spark, sf):
    return aggregate.year_quantile(tables.pair(spark, sf), TP, 0.98)


@query(
    "season_quantile",
    f"with {PAIR} select y, x, {season()} as season, {_q(0.02)} from pair group by all",
)
def season_quantile(spark, sf):
    return aggregate.season_quantile(tables.pair(spark, sf), TP, 0.02)


@query(
    "time_mean",
    f"with {PAIR} select y, x, {r('avg(truth)')} as truth_mean, {r('avg(pred)')} as pred_mean from pair group by y, x",
)
def time_mean(spark, sf):
    return aggregate.time_mean(tables.pair(spark, sf), TP)


@query(
    "time_std",
    f"with {PAIR} select y, x, {r('stddev_pop(truth)')} as truth_std, {r('stddev_pop(pred)')} as pred_std from pair group by y, x",
)
def time_std(spark, sf):
    return aggregate.time_std(tables.pair(spark, sf), TP)


@query(
    "time_median",
    f"with {PAIR} select y, x, {r('median(truth)')} as truth_median, {r('median(pred)')} as pred_median from pair group by y, x",
)
def time_median(spark, sf):
    return aggregate.time_median(tables.pair(spark, sf), TP)


@query(
    "time_quantile_features",
    f"""with {PAIR} select y, x, {", ".join(f"{r(f'quantile_cont({v}, {p})')} as {v}_{n}" for v in TP for p, n in ((0.1, 10), (0.9, 90)))}
      from pair group by y, x""",
)
def time_quantile_features(spark, sf):
    return aggregate.time_quantile_features(tables.pair(spark, sf), TP)


@query(
    "global_summary",
    f"with {PAIR} "
    + " union all ".join(
        f"""select '{v}' as dataset, {r(f'avg({v})')} as mean, {r(f'stddev_pop({v})')} as std, {r(f'min({v})')} as min,
        {r(f'max({v})')} as max, {r(f'median({v})')} as median from pair"""
        for v in TP
    ),
)
def global_summary(spark, sf):
    return aggregate.global_summary(stored(tables.pair(spark, sf).select(*TP)), TP)


@query(
    "time_range",
    f"with {PAIR} select cast(year(min(time)) as int) as first_year, cast(year(max(time)) as int) as last_year from pair",
)
def time_range(spark, sf):
    return aggregate.time_range(tables.pair(spark, sf))


_F = tables.FEATURES


@query(
    "correlation_matrix",
    f"""with {EMB}, long as ({" union all ".join(f"select vec_id, {i} as i, '{f}' as f, {f} as v from emb" for i, f in enumerate(_F))})
      select p.f as a, q.f as b, {r('corr(p.v, q.v)')} as r from long p join long q on p.vec_id = q.vec_id and q.i < p.i
      group by p.f, q.f""",
)
def correlation_matrix(spark, sf):
    return aggregate.correlation_matrix(tables.emb(spark, sf), _F)


_BOX = """q as (select {0}, quantile_cont(value, 0.25) as q1, median(value) as median,
    quantile_cont(value, 0.75) as q3 from long where value is not null group by {0}),
  f as (select l.*, q1, median, q3, value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) as inside
    from long l join q using ({0}) where value is not null)"""


def box_sql(prefix: str, keys: str) -> str:
    return f"""with {prefix}, {_BOX.format(keys)}
      select {keys}, {r('q1')} as q1, {r('median')} as median, {r('q3')} as q3,
        {r('min(value) filter (inside)')} as whisker_low, {r('max(value) filter (inside)')} as whisker_high,
        count(*) filter (not inside) as outliers, count(*) as n from f group by {keys}, q1, median, q3"""


@query(
    "box_stats",
    box_sql(f"{PAIR}, long as (select cast(year(time) as int) as year, pred - truth as value from pair)", "year"),
)
def box_stats(spark, sf):
    errors = tables.pair(spark, sf).select(
        F.year("time").alias("year"), (F.col("pred") - F.col("truth")).alias("value")
    )
    return aggregate.box_stats(stored(errors), ["year"], "value")


@query(
    "bias_distribution",
    f"""with {PAIR}, ym as (select y, x, year(time) as year, avg(truth) as t, avg(pred) as p from pair group by 1, 2, 3),
      m as (select y, x, avg(p) - avg(t) as bias from ym group by 1, 2),
      e as (select min(bias) as lo, max(bias) as hi, median(bias) as median from m),
      b as (select unnest(generate_series(0, 9)) as bin),
      c as (select least(floor((bias - lo) / ((hi - lo) / 10)), 9) as bin, count(*) as n from m, e group by 1)
      select cast(b.bin as int) as bin, {r('lo + (hi - lo) / 10 * b.bin')} as lo,
        {r('lo + (hi - lo) / 10 * (b.bin + 1)')} as hi, coalesce(n, 0) as n, {r('median')} as median
      from b cross join e left join c on c.bin = b.bin""",
)
def bias_distribution(spark, sf):
    field = stored(verification.bias_map(tables.pair(spark, sf)))
    median = aggregate.quantile_columns(field, [], "bias", {"median": 0.5})
    return aggregate.attach(terrain.histogram(field, "bias", 10), median, [])
