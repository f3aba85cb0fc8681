"""Composed runs and the incremental aggregation."""

import datetime as dt

from pyspark.sql import functions as F

from gridloom.plans import runs
from gridloom.sources import tables
from gridloom.streaming import daily


def test_downscale_then_verify(spark, sf, tmp_path):
    pair = tables.pair(spark, sf).cache()
    past = pair.filter("time < '1999-01-01'").select("time", "y", "x", "pred")
    observed = pair.select("time", "y", "x", F.col("truth").alias("tasmean"))
    later = pair.filter("time >= '1999-01-01'").select(
        "time", "y", "x", "pred", F.explode(F.array(F.lit(1), F.lit(2))).alias("member")
    )

    def run(frame):
        return runs.downscale_forecast(
            past, observed, frame, ["pred"], "tasmean", "LGBMRegressor", str(tmp_path), "r1",
            static=tables.dem(spark, sf), drop_invalid_cells=False, rounds=3,
        )

    first = run(later)
    assert first.count() == later.count() and first.filter("tasmean is null").count() == 0
    # A finished run is not computed again.
    assert run(later.limit(1)).count() == first.count()
    scores = runs.verify_run(
        pair, first.filter("member = 1").select("time", "y", "x", F.col("tasmean").alias("pred"))
    )
    names = {r.score for r in scores.collect()}
    assert {"monthly_r2", "anomaly_r2", "yearly_bias", "yearly_rmse", "p98_mae", "r_pooled"} <= names


def test_cells_with_gaps_get_no_model(spark, tmp_path):
    start = dt.date(2000, 1, 1)
    rows = [(start + dt.timedelta(days=i), 0, x, float(i), None if x and i == 3 else 2.0 * i) for i in range(40) for x in (0, 1)]
    cube = spark.createDataFrame(rows, "time date, y int, x int, t2m double, tasmax double")
    out = runs.downscale_forecast(
        cube.drop("tasmax"), cube, cube.drop("tasmax"), ["t2m"], "tasmax", "RandomForestRegressor",
        str(tmp_path), "r2", trees=3,
    )
    missing = {r.x: r.n for r in out.groupBy("x").agg(F.count_if(F.col("tasmax").isNull()).alias("n")).collect()}
    assert missing == {0: 0, 1: 40}


def test_prepare_commutes_for_means(spark):
    rows = [
        (dt.datetime(2001, 1, d, h), y, x, float(d * h + 10 * y + x)) for d in (1, 2) for h in (0, 12) for y in range(3) for x in range(3)
    ]
    cube = spark.createDataFrame(rows, "ts timestamp_ntz, y int, x int, t2m double")
    axis = spark.createDataFrame([(0.5,), (1.5,)], "c double")
    ty, tx = axis.select(F.col("c").alias("y")), axis.select(F.col("c").alias("x"))
    a, b = (
        sorted((r.time, r.y, r.x, round(r.t2m, 9)) for r in runs.prepare_reanalysis(cube, ty, tx, "t2m", regrid_first=f).collect())
        for f in (False, True)
    )
    assert a == b and len(a) == 8


def test_ensemble_scores(spark, sf):
    out = runs.verify_ensemble(tables.ens(spark, sf), tables.monthly_truth(spark, sf))
    assert out["ranks"].agg(F.sum("n")).first()[0] > 0
    assert out["crps_map"].filter("crps < 0").count() == 0


def test_days_arrive_once(spark, tmp_path):
    schema = "ts timestamp, x int, v double"
    source, sink, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))

    def arrive(days):
        rows = [(dt.datetime(2001, 1, d, h), x, float(d + h)) for d in days for h in (0, 12) for x in (0, 1)]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream = daily.read_arrivals(spark, source, spark.createDataFrame([], schema).schema)
        daily.append_days(daily.daily_stream(stream, ["x"], "v"), sink, marks).awaitTermination()
        return {(r.time.day, r.x): r.v for r in spark.read.parquet(sink).collect()}

    assert set(arrive([1, 2, 3])) >= {(1, 0), (1, 1)}
    out = arrive([4, 5, 6])
    assert out[(1, 0)] == 7.0 and {(d, 0) for d in (1, 2, 3, 4)} <= set(out)
    assert spark.read.parquet(sink).count() == len(out)
