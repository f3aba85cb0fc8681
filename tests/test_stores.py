"""Cell-major store, Z-order, folded quantile mapping, many k at once, permutation importance."""

import datetime as dt
import glob
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gridloom.operators import bias, learning, regions, selection
from gridloom.sources import cellstore, zorder


def cube(spark, days=400, rows=6, columns=5):
    return spark.range(days * rows * columns).select(
        F.expr(f"date_add(date'2000-01-01', cast(id div {rows * columns} as int))").alias("time"),
        F.expr(f"cast(id div {columns} % {rows} as double)").alias("y"),
        F.expr(f"cast(id % {columns} as double)").alias("x"),
        F.expr("cast(id * 7919 % 1009 as double)").alias("pred"),
        F.expr("cast(id * 104729 % 997 as double)").alias("truth"),
    )


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_work_per_cell_on_the_store_has_no_exchange(spark, tmp_path):
    store = cellstore.write_store(cube(spark), str(tmp_path), 4)
    assert len(glob.glob(f"{tmp_path}/cells_by_4/*.parquet")) == 4
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # the models could be broadcast; here they meet the cube in its buckets
    try:
        for df in (
            cellstore.store_anomaly(store, ["pred", "truth"]),
            cellstore.store_anomaly(store, ["pred"], "dayofyear", standard=True),
            cellstore.store_fit_predict(store, "pred", "truth", "2000-12-01"),
        ):
            assert "Exchange" not in plan(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    again = cellstore.open_store(spark, str(tmp_path)).drop("cell")
    assert again.exceptAll(cube(spark)).isEmpty() and again.count() == cube(spark).count()
    with pytest.raises(FileExistsError):
        cellstore.write_store(cube(spark), str(tmp_path), 4)
    with pytest.raises(FileNotFoundError):
        cellstore.open_store(spark, f"{tmp_path}/nothing")


def test_bucket_count(spark):
    assert cellstore.bucket_count(cube(spark), 1000) == 12
    assert cellstore.bucket_count(cube(spark), 10) == 30  # no more than cells
    assert cellstore.bucket_count(cube(spark).limit(0)) == 1


def test_z_order_interleaves_bits(spark):
    df = spark.createDataFrame([(a, b) for a in range(4) for b in range(4)], "a long, b long")
    got = df.select("a", "b", zorder.interleaved([F.col("a"), F.col("b")], 2).alias("z")).collect()
    assert all(r["z"] == sum((r["a"] >> i & 1) << 2 * i | (r["b"] >> i & 1) << 2 * i + 1 for i in range(2)) for r in got)
    with pytest.raises(ValueError):
        zorder.interleaved([F.col("a")] * 4, 16)


def test_a_small_box_reads_few_row_groups(spark, tmp_path):
    df = cube(spark, 1024, 16, 16)
    path = f"{tmp_path}/curve"
    zorder.write_ordered(df, path, file_rows=65_536, group_rows=1024)
    groups = sum(pq.ParquetFile(f).num_row_groups for f in glob.glob(f"{path}/*.parquet"))
    assert groups >= 200
    box = selection.time_slice(selection.bbox_clip(spark.read.parquet(path), (2, 5), (9, 12)), "2000-03-01", "2000-05-31")
    assert box.exceptAll(selection.time_slice(selection.bbox_clip(df, (2, 5), (9, 12)), "2000-03-01", "2000-05-31")).isEmpty()
    assert len(box.collect()) == 16 * 92
    leaf = box._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert leaf.metrics().apply("numOutputRows").value() <= 0.1 * df.count()


def test_z_order_of_missing_and_constant_axes(spark, tmp_path):
    rows = [(None, 1.0, 2.0, 3.0), (dt.date(2000, 1, 1), 1.0, None, 4.0), (dt.date(2000, 1, 9), 1.0, 5.0, None)]
    df = spark.createDataFrame(rows, "time date, y double, x double, v double")
    zorder.write_ordered(df, f"{tmp_path}/some")
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/some").collect())) == sorted(map(str, df.collect()))
    zorder.write_ordered(df.limit(0), f"{tmp_path}/none")
    assert spark.read.schema(df.schema).parquet(f"{tmp_path}/none").count() == 0


def mapped(obs, mod, value):
    """Plain form of the mapping for one cell and one value."""
    obs, mod = sorted(obs), sorted(mod)
    share = sum(m <= value for m in mod) / len(mod)

    def at(series):
        h = share * (len(series) - 1)
        low = int(h)
        return series[low] + ((series[low + 1] - series[low]) * (h - low) if low + 1 < len(series) else 0.0)

    return value + at(obs) - at(mod)


@pytest.mark.parametrize("width", [None, 2.5])
def test_quantile_map_folds_equal_values(spark, width):
    draw = random.Random(5)

    def rain(n, cell):
        return [(cell, 0.0, max(0.0, round(draw.gauss(0, 4), 1))) for _ in range(n)]

    obs, mod, later = (rain(n, 0.0) + rain(n // 3, 1.0) for n in (500, 400, 300))
    schema = "y double, x double, value double"
    frames = [spark.createDataFrame(r, schema).repartition(7) for r in (obs, mod, later)]
    steps = bias.ladder(*frames, "value", ["y", "x"], width)
    assert steps.filter("v = 0").count() == 2  # the zeros of a cell are one row
    got = sorted((r["y"], r["value"], round(r["corrected"], 9)) for r in bias.quantile_map(*frames, "value", width=width).collect())
    want = sorted(
        (y, v, round(mapped([o[2] for o in obs if o[0] == y], [m[2] for m in mod if m[0] == y], v), 9)) for y, _, v in later
    )
    assert got == want


def test_many_k_at_once(spark):
    points = [(i, float(i % 3) * 10 + (i % 7) * 0.01, float(i % 2)) for i in range(120)] + [(900, None, 1.0), (901, float("nan"), 1.0)]
    df = spark.createDataFrame(points, "id long, a double, b double")
    got = [regions.kmeans_many(df.repartition(n), "id", ["a", "b"], [2, 3, 6]).collect() for n in (1, 5)]
    assert len(got[0]) == 122 * 3 and {tuple(r) for r in got[0]} == {tuple(r) for r in got[1]}
    assert {r["region"] for r in got[0] if r["id"] >= 900} == {None}
    label = {r["id"]: r["region"] for r in got[0] if r["k"] == 6 and r["id"] < 900}
    assert len(set(label.values())) <= 6
    assert regions.kmeans_many(df.filter("id < 0"), "id", ["a", "b"], [2]).count() == 0
    # fewer rows than centres: each row is its own region
    few = regions.kmeans_many(df.filter("id < 3"), "id", ["a", "b"], [6]).collect()
    assert len({r["region"] for r in few}) == 3


def test_permutation_importance(spark):
    rows = spark.range(3000).select(
        "id", F.expr("cast(id * 7919 % 1009 as double)").alias("a"), F.expr("cast(id * 31 % 101 as double)").alias("b"), F.lit(1.5).alias("c")
    )
    rows = rows.withColumn("truth", 2 * F.col("a") + 0.1 * F.col("b"))

    def predict(df):
        return df.withColumn("predicted", 2 * F.col("a") + 0.1 * F.col("b"))

    got = [
        {r["feature"]: (r["importance"], r["n"]) for r in learning.permutation_importance(rows.repartition(n), ["id"], ["a", "b", "c"], "truth", predict).collect()}
        for n in (1, 4)
    ]
    assert got[0] == got[1] and got[0]["c"] == (0.0, 3000)
    # a permuted feature's error is about twice its variance times its squared weight
    spread = rows.agg(F.var_pop("a").alias("a"), F.var_pop("b").alias("b")).first()
    assert got[0]["a"][0] == pytest.approx(8 * spread["a"], rel=0.1) and got[0]["b"][0] == pytest.approx(0.02 * spread["b"], rel=0.1)
