"""Feature engineering and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import numeric
from gridloom.operators import features, resample
from gridloom.plans.catalog.base import EMB, PAIR, RAIN, SUB, d, query, r, ratio
from gridloom.sources import cellstore, tables
from gridloom.sources.workspace import fresh_path, stored

KEYS = ["time", "y", "x"]
_HEAD = f"select {d('time')} as time, y, x"


@query(
    "doy_encode",
    f"""with {PAIR} {_HEAD}, {r('sin(2 * pi() * dayofyear(time) / 365.0)')} as doy_sin,
      {r('cos(2 * pi() * dayofyear(time) / 365.0)')} as doy_cos from pair""",
)
def doy_encode(spark, sf):
    return features.doy_encode(tables.pair(spark, sf).select(*KEYS))


def _anomaly_sql(bucket: str, divide: str = "") -> str:
    parts = []
    for v in ("truth", "pred"):
        shifted = f"{v} - avg({v}) over (partition by y, x, {bucket})"
        if divide:
            shifted = ratio(shifted, f"stddev_pop({v}) over (partition by y, x, {bucket})")
        parts.append(f"{r(shifted)} as {v}")
    return f"with {PAIR} {_HEAD}, {', '.join(parts)} from pair"


@query("anomaly", _anomaly_sql("month(time)"))
def anomaly(spark, sf):
    cube = stored(tables.pair(spark, sf).select(*KEYS, "truth", "pred"))
    return features.anomaly(cube, ["y", "x"], ["truth", "pred"], "month")


@query("anomaly_from_store", _anomaly_sql("month(time)", "std"))
def anomaly_from_store(spark, sf):
    cube = stored(tables.pair(spark, sf).select("time", "y", "x", "truth", "pred"))
    store = cellstore.write_store(cube, fresh_path(spark, "store"), cellstore.bucket_count(cube))
    return cellstore.store_anomaly(store, ["truth", "pred"], "month", standard=True).drop(cellstore.KEY)


@query("anomaly_doy", _anomaly_sql("dayofyear(time)"))
def anomaly_doy(spark, sf):
    cube = stored(tables.pair(spark, sf).select(*KEYS, "truth", "pred"))
    return features.anomaly(cube, ["y", "x"], ["truth", "pred"], "dayofyear")


@query("anomaly_standardized", _anomaly_sql("month(time)", "std"))
def anomaly_standardized(spark, sf):
    cube = stored(tables.pair(spark, sf).select(*KEYS, "truth", "pred"))
    return features.anomaly(cube, ["y", "x"], ["truth", "pred"], "month", standard=True)


@query(
    "minmax_period",
    f"""with {PAIR}, e as (select min(truth) as tl, max(truth) as th, min(pred) as pl, max(pred) as ph
        from pair where time between date '1996-01-01' and date '1998-12-31')
      {_HEAD}, {r('(truth - tl) / nullif(th - tl, 0)')} as truth, {r('(pred - pl) / nullif(ph - pl, 0)')} as pred
      from pair, e""",
)
def minmax_period(spark, sf):
    cube = stored(tables.pair(spark, sf).select(*KEYS, "truth", "pred"))
    return features.minmax_period(cube, ["truth", "pred"], ("1996-01-01", "1998-12-31"))


@query(
    "minmax_row",
    f"""with {PAIR}, m as (select *, least(truth, pred, refe) as lo, greatest(truth, pred, refe) as hi,
        truth is not null as whole from pair)
      {_HEAD}, {", ".join(f"{r(f'case when whole then ({v} - lo) / nullif(hi - lo, 0) end')} as {v}" for v in ("truth", "pred", "refe"))}
      from m""",
)
def minmax_row(spark, sf):
    return features.minmax_row(tables.pair(spark, sf), ["truth", "pred", "refe"])


_F = tables.FEATURES


@query(
    "minmax_column",
    f"""with {EMB}, e as (select {", ".join(f"min({f}) as lo_{f}, max({f}) as hi_{f}" for f in _F)} from emb)
      select vec_id, {", ".join(f"{r(f'({f} - lo_{f}) / nullif(hi_{f} - lo_{f}, 0)')} as {f}" for f in _F)} from emb, e""",
)
def minmax_column(spark, sf):
    return features.minmax_column(tables.emb(spark, sf).drop("label"), _F)


@query(
    "minmax_compare",
    f"""with {RAIN}, e as (select min(truth) as tl, max(truth) as th, min(pred) as pl, max(pred) as ph from rain)
      {_HEAD}, {r('(truth - tl) / nullif(th - tl, 0) * 1000')} as truth,
      {r('(pred - pl) / nullif(ph - pl, 0) * 1000')} as pred from rain, e""",
)
def minmax_compare(spark, sf):
    cube = stored(tables.rain(spark, sf).select(*KEYS, "truth", "pred"))
    return features.minmax_column(cube, ["truth", "pred"], factor=1000.0)


def _zscore_sql(deviation: str) -> str:
    stats = ", ".join(f"avg({v}) as m_{v}, {deviation}({v}) as s_{v}" for v in ("truth", "pred"))
    cols = ", ".join(f"{r(f'({v} - m_{v}) / nullif(s_{v}, 0)')} as {v}" for v in ("truth", "pred"))
    return f"with {PAIR}, e as (select {stats} from pair) {_HEAD}, {cols} from pair, e"


@query("zscore_sample", _zscore_sql("stddev_samp"))
def zscore_sample(spark, sf):
    return features.zscore(stored(tables.pair(spark, sf).select(*KEYS, "truth", "pred")), ["truth", "pred"])


@query("zscore_pop", _zscore_sql("stddev_pop"))
def zscore_pop(spark, sf):
    cube = stored(tables.pair(spark, sf).select(*KEYS, "truth", "pred"))
    return features.zscore(cube, ["truth", "pred"], sample=False)


@query(
    "unit_convert",
    f"""with {PAIR} {_HEAD}, {r('truth - 273.15')} as truth, {r('pred * 1000')} as pred,
      {r('refe * 1000 / 6')} as refe from pair""",
)
def unit_convert(spark, sf):
    return features.unit_convert(
        tables.pair(spark, sf),
        {
            "truth": numeric.kelvin_to_celsius("truth"),
            "pred": numeric.metres_to_millimetres("pred"),
            "refe": numeric.flux_to_step_millimetres("refe", 6),
        },
    )


@query(
    "valid_cells",
    f"""with {SUB}, cells as (select distinct x, variable from sub),
      days as (select cast(unnest(generate_series(cast(min(ts) as date), cast(max(ts) as date),
        interval 1 day)) as date) as time from sub),
      daily as (select c.x, c.variable, d.time, avg(value) as value from cells c cross join days d
        left join sub s on s.x = c.x and s.variable = c.variable and cast(s.ts as date) = d.time group by 1, 2, 3)
      select x, variable, {d('time')} as time, {r('value')} as value from daily
      where (x, variable) not in (select (x, variable) from daily where value is null)""",
)
def valid_cells(spark, sf):
    daily = resample.daily_mean(tables.sub(spark, sf), ["x", "variable"])
    return features.valid_cells(daily, ["x", "variable"], ["value"])


@query(
    "mask_by_truth",
    f"""with {PAIR} {_HEAD}, {r('truth')} as truth,
      {r('case when truth is not null then pred end')} as pred,
      {r('case when truth is not null then refe end')} as refe from pair""",
)
def mask_by_truth(spark, sf):
    return features.mask_by_truth(tables.pair(spark, sf), "truth", ["pred", "refe"])


@query(
    "fill_sentinel",
    f"""with {PAIR} {_HEAD}, {r('coalesce(truth, 9999)')} as truth, {r('pred')} as pred from pair""",
)
def fill_sentinel(spark, sf):
    cube = tables.pair(spark, sf).select(*KEYS, "truth", "pred")
    return features.fill_sentinel(cube, ["truth", "pred"])


@query(
    "melt_features",
    f"with {EMB} "
    + " union all ".join(f"select vec_id, label, '{f}' as feature, {r(f)} as value from emb" for f in _F),
)
def melt_features(spark, sf):
    return features.melt_features(tables.emb(spark, sf), ["vec_id", "label"], _F)


@query(
    "cell_series",
    f"""with {PAIR}, s as (select *, cast(year(time) as int) as year,
        row_number() over (partition by y, x, year(time) order by time) as i from pair)
      select y, x, year, cast(count(*) as int) as steps, {d('min(time)')} as first_day, {d('max(time)')} as last_day,
        {r('round(sum(i * pred), 3)')} as pred_moment, {r('round(sum(i * coalesce(truth, 0)), 3)')} as truth_moment
      from s group by y, x, year""",
)
def cell_series(spark, sf):
    series = features.cell_series(tables.pair(spark, sf), ["truth", "pred"])

    def moment(field):
        numbered = F.zip_with(
            "series",
            F.sequence(F.lit(1), F.size("series")),
            lambda e, i: i * F.coalesce(e[field], F.lit(0.0)),
        )
        return F.round(F.aggregate(numbered, F.lit(0.0), lambda a, b: a + b), 3)

    return series.select(
        "y",
        "x",
        "year",
        F.size("series").alias("steps"),
        F.element_at("series", 1)["time"].alias("first_day"),
        F.element_at("series", -1)["time"].alias("last_day"),
        moment("pred").alias("pred_moment"),
        moment("truth").alias("truth_moment"),
    )
