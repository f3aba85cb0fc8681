"""Registration of a query together with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Comparable output: doubles to six decimals, dates as text."""

    def one(field):
        c = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(field.dataType, (T.DateType, T.TimestampNTZType)):
            c = c.cast("string")
        return c.alias(field.name)

    return df.select(*[one(f) for f in df.schema])


def query(key: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under `key`."""

    def register(fn):
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")

        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(spark, sf_dir))

        QUERIES[key] = run
        if sql:
            SQL[key] = sql
        return fn

    return register


def r(expression: str) -> str:
    """Six decimals, without negative zero."""
    return f"(round({expression}, 6) + 0.0)"


def d(expression: str) -> str:
    """A date as text."""
    return f"cast(cast({expression} as date) as varchar)"


def ratio(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def relative(p: str, t: str) -> str:
    return f"(100.0 * ({p} - {t}) / nullif({t}, 0))"


SEASON = (
    "case when month({0}) in (12, 1, 2) then 'DJF' when month({0}) in (3, 4, 5) then 'MAM' "
    "when month({0}) in (6, 7, 8) then 'JJA' else 'SON' end"
)


def season(time: str = "time") -> str:
    return SEASON.format(time)


PAIR = """pair as (
  select time, y, x, case when (dayofyear(time) + 3 * y + x) % 17 <> 0 then t end as truth, pred, refe
  from (
    select cast(l_shipdate as date) as time, cast(l_suppkey % 5 as int) as y, cast(l_partkey % 5 as int) as x,
      cast(sum(cast(round(l_quantity * 100) as bigint)) as double) / (count(*) * 99.991::double) as t,
      cast(sum(cast(round(l_extendedprice * 100) as bigint)) as double) / (count(*) * (2100 * 99.991::double)) as pred,
      cast(sum(cast(round(l_quantity * (1 + l_discount - l_tax) * 100) as bigint)) as double)
        / (count(*) * 99.991::double) as refe
    from lineitem group by 1, 2, 3))"""

RAIN = PAIR + """,
rain as (
  select time, y, x, case when truth is not null then greatest(truth - 25, 0) end as truth,
    greatest(pred - 25, 0) as pred, greatest(refe - 25, 0) as refe from pair)"""

BOOKED = """booked as (
  select cast(o_orderdate as date) as time, cast(o_custkey % 5 as int) as y,
    cast(o_orderkey % 5 as int) as x,
    cast(sum(cast(round(o_totalprice * 100) as bigint)) as double) / (count(*) * (7000 * 99.991::double)) as model
  from orders group by 1, 2, 3)"""

ENS = """ens as (
  select cast(date_trunc('month', l_shipdate) as date) as time, cast(l_suppkey % 5 as int) as y,
    cast(l_partkey % 5 as int) as x, l_linenumber as member,
    cast(sum(cast(round(l_extendedprice * 100) as bigint)) as double) / (count(*) * (2100 * 99.991::double)) as pred
  from lineitem group by 1, 2, 3, 4)"""

MONTHLY_TRUTH = PAIR + """,
obs as (
  select cast(date_trunc('month', time) as date) as time, y, x, avg(truth) as truth
  from pair group by 1, 2, 3)"""

SUB = """sub as (
  select ts, cast(user_id % 10 as int) as x, event_type as variable,
    case event_type when 'click' then 250 when 'view' then 500 when 'purchase' then 850
      when 'signup' then 925 else 1000 end as level, value / (99.991::double / 100) as value
  from events)"""

DEM = """dem as (
  select cast(floor(p_partkey / 20) as int) as y, cast(p_partkey % 20 as int) as x,
    p_retailprice as elevation
  from part)"""

LEAD = """lead_t as (
  select o_orderkey as id, cast(o_orderdate as date) as time, cast(o_custkey % 5 as int) as x,
    cast(date_trunc('month', o_orderdate) - to_months(cast(o_custkey % 7 as int)) as date) as init,
    o_totalprice as value
  from orders)"""

EMB = (
    "emb as (select vec_id, label, "
    + ", ".join(f"cast(embedding[{i + 1}] as double) as f{i}" for i in range(64))
    + " from embeddings)"
)
