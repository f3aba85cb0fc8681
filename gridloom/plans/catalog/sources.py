"""Sources, sinks and selection."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.operators import selection
from gridloom.plans.catalog.base import DEM, PAIR, SUB, d, query, r
from gridloom.sources import files, snapshots, tables, zorder
from gridloom.sources.workspace import fresh_path, stored

_DATES = T.StructType([T.StructField("day", T.TimestampNTZType())])


@query(
    "scan_files",
    """select source, year, count(*) as n, year as file_year from (
      select 'lineitem' as source, cast(year(l_shipdate) as int) as year from lineitem
      union all select 'orders', cast(year(o_orderdate) as int) from orders) group by 1, 2""",
)
def scan_files(spark, sf):
    """Files with source and year in their names are written, searched and read again."""
    lines = tables.read(spark, sf, "lineitem").select(F.lit("lineitem").alias("source"), F.col("l_shipdate").alias("day"))
    orders = tables.read(spark, sf, "orders").select(F.lit("orders").alias("source"), F.col("o_orderdate").alias("day"))
    path = fresh_path(spark, "files")
    named = lines.unionByName(orders).select("day", F.concat_ws("_", "source", F.year("day")).alias("set"))
    named.hint("rebalance", "set").write.partitionBy("set").parquet(path)
    found = files.scan_files(spark, path, r"/set=(lineitem|orders)_\d{4}/", _DATES, years=(1900, 2099))
    source = F.regexp_extract("file", r"/set=(lineitem|orders)_\d{4}/", 1)
    return found.groupBy(source.alias("source"), F.year("day").alias("year"), "file_year").agg(F.count(F.lit(1)).alias("n"))


@query(
    "concat_years",
    f"with {PAIR} select {d('time')} as time, y, x, {r('truth')} as truth, {r('pred')} as pred from pair",
)
def concat_years(spark, sf):
    """The cube is written in two parts, which are read back as one."""
    parts = [fresh_path(spark, "years") for _ in range(2)]
    tables.pair(spark, sf, end="1998-01-01").write.parquet(parts[0])
    tables.pair(spark, sf, start="1998-01-01").write.parquet(parts[1])
    return files.read_years(spark, parts).select("time", "y", "x", "truth", "pred")


@query(
    "select_vars",
    f"with {PAIR} select {d('time')} as time, y, x, {r('pred')} as pred from pair",
)
def select_vars(spark, sf):
    return selection.select_vars(tables.pair(spark, sf), ["time", "y", "x"], ["pred", "t2m", "z"])


_LEVELS = [250, 500, 850]


@query(
    "level_pivot",
    f"""with {SUB} select strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts, x,
      {", ".join(f"{r(f'max(case when level = {v} then value end)')} as v_{v}" for v in _LEVELS)},
      cast(null as double) as v_700
      from sub where level in (250, 500, 850) group by ts, x""",
)
def level_pivot(spark, sf):
    wide = selection.level_pivot(
        tables.sub(spark, sf).withColumnRenamed("value", "v"), ["ts", "x"], ["v"], [*_LEVELS, 700]
    )
    return wide.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), *wide.columns[1:])


@query(
    "level_concat",
    f"""with {SUB}
      select strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts, x, level, {r('value')} as value
      from sub where level in (850, 500)""",
)
def level_concat(spark, sf):
    sub = tables.sub(spark, sf)
    parts = {
        lev: sub.filter(F.col("level") == lev).select("ts", "x", "value") for lev in (850, 500)
    }
    out = selection.level_concat(parts)
    return out.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(
    "variable_split",
    f"""with {PAIR}
      select {d('time')} as time, y, x, 'truth' as variable, {r('truth')} as value from pair
      union all select {d('time')}, y, x, 'pred', {r('pred')} from pair
      union all select {d('time')}, y, x, 'refe', {r('refe')} from pair""",
)
def variable_split(spark, sf):
    """One folder per variable is written and read back."""
    long = files.split_variables(tables.pair(spark, sf), ["time", "y", "x"], ["truth", "pred", "refe"])
    path = fresh_path(spark, "variables")
    files.write_variables(long, path, by=("variable",))
    return spark.read.parquet(path).select("time", "y", "x", "variable", "value")


@query(
    "canonicalize",
    f"""with {PAIR} select {d('time')} as time, cast(y as double) as y, cast(x as double) as x,
      {r('pred')} as t2m from pair""",
)
def canonicalize(spark, sf):
    raw = tables.pair(spark, sf).select(
        "refe",
        F.col("pred").alias("2t"),
        F.col("x").alias("longitude"),
        F.col("y").alias("latitude"),
        F.col("time").cast("timestamp_ntz").alias("valid_time"),
    )
    return selection.canonicalize(raw, {"2t": "t2m"})


@query(
    "bbox_clip",
    f"""with {PAIR} select {d('time')} as time, y, x, {r('pred')} as pred from pair
      where y between 1 and 3 and x between 2 and 4""",
)
def bbox_clip(spark, sf):
    cube = tables.pair(spark, sf).select("time", "y", "x", "pred")
    return selection.bbox_clip(cube, (1, 3), (2, 4))


@query(
    "index_window",
    f"""with {DEM} select y, x, {r('elevation')} as elevation from (
      select *, dense_rank() over (order by y) as ry, dense_rank() over (order by x) as rx from dem)
      where ry <= 25 and rx <= 20""",
)
def index_window(spark, sf):
    return selection.index_window(tables.dem(spark, sf), 25, 20).select("y", "x", "elevation")


@query(
    "time_slice",
    f"""with {PAIR} select {d('time')} as time, y, x, {r('pred')} as pred from pair
      where time between date '1996-01-01' and date '1997-12-31'""",
)
def time_slice(spark, sf):
    cube = tables.pair(spark, sf, start="1996-01-01", end="1998-01-01")
    return selection.time_slice(cube.select("time", "y", "x", "pred"), "1996-01-01", "1997-12-31")


@query(
    "first_n_steps",
    f"""with {PAIR} select {d('time')} as time, y, x, {r('pred')} as pred from (
      select *, dense_rank() over (order by time) as step from pair) where step <= 30""",
)
def first_n_steps(spark, sf):
    return selection.first_n_steps(stored(tables.pair(spark, sf).select("time", "y", "x", "pred")), 30)


@query(
    "match_time",
    f"""with {PAIR} select {d('time')} as time, y, x, {r('truth')} as truth from pair
      where time in (select cast(o_orderdate as date) from orders where o_orderpriority = '1-URGENT')""",
)
def match_time(spark, sf):
    orders = tables.read(spark, sf, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    forecast = orders.select(F.to_date("o_orderdate").alias("time"))
    return selection.match_time(tables.pair(spark, sf).select("time", "y", "x", "truth"), forecast)


@query(
    "match_cells",
    f"""with {DEM}, {PAIR} select y, x, {r('elevation')} as elevation from dem
      where (y, x) in (select y, x from pair)""",
)
def match_cells(spark, sf):
    return selection.match_cells(tables.dem(spark, sf), tables.pair(spark, sf))


@query(
    "write_cube",
    f"""with {PAIR} select {d('time')} as time, y, x, {r('pred')} as pred,
      cast(year(time) as int) as year, 'demo' as run_key from pair""",
)
def write_cube(spark, sf):
    path = fresh_path(spark, "cube")
    files.write_cube(tables.pair(spark, sf).select("time", "y", "x", "pred"), path, "demo")
    return spark.read.option("basePath", path).parquet(path)


@query(
    "zorder_box",
    f"""with {PAIR} select {d('time')} as time, y, x, {r('pred')} as pred from pair
      where y between 1 and 2 and x between 2 and 3 and time between date '1996-01-01' and date '1996-06-30'""",
)
def zorder_box(spark, sf):
    """A box of time and space from a cube in Z-order: row groups outside it are skipped."""
    path = fresh_path(spark, "curve")
    zorder.write_ordered(stored(tables.pair(spark, sf).select("time", "y", "x", "pred")), path)
    return selection.time_slice(selection.bbox_clip(spark.read.parquet(path), (1, 2), (2, 3)), "1996-01-01", "1996-06-30")


@query(
    "publish_cube",
    f"""with {PAIR} select {d('time')} as time, y, x, {r('truth')} as pred,
      cast(year(time) as int) as year, 'demo' as run_key from pair""",
)
def publish_cube(spark, sf):
    path = fresh_path(spark, "published")
    pair = tables.pair(spark, sf)
    snapshots.publish_cube(pair.select("time", "y", "x", "pred"), path, "demo")
    snapshots.publish_cube(pair.select("time", "y", "x", F.col("truth").alias("pred")), path, "demo", overwrite=True)
    snapshots.prune(spark, path, "demo", keep=1)
    return snapshots.read_published(spark, path, ["demo"])
