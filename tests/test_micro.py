"""Hand-computed micro-cubes."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from gridloom.functions.calendar import season
from gridloom.functions.numeric import nan_to_null, r2
from gridloom.operators import (
    aggregate,
    align,
    bias,
    ensemble,
    features,
    regrid,
    resample,
    selection,
    splitting,
    terrain,
    verification,
)
from gridloom.sources import files

D = dt.date


def day(i, year=2001):
    return D(year, 1, 1) + dt.timedelta(days=i)


def test_nan_becomes_null(spark):
    df = nan_to_null(spark.createDataFrame([(1.0,), (float("nan"),)], "v double"))
    assert sorted((r.v for r in df.collect()), key=str) == [1.0, None]


def test_leap_day_angle(spark):
    df = spark.createDataFrame([(D(2000, 12, 31),), (D(2001, 12, 31),)], "time date")
    rows = {r.time.year: r for r in features.doy_encode(df).collect()}
    assert math.isclose(rows[2001].doy_sin, math.sin(2 * math.pi), abs_tol=1e-12)
    assert math.isclose(rows[2000].doy_sin, math.sin(2 * math.pi * 366 / 365), abs_tol=1e-12)


def test_seasons(spark):
    df = spark.createDataFrame([(D(2001, m, 15),) for m in range(1, 13)], "time date")
    got = {r.time.month: r.s for r in df.select("time", season("time").alias("s")).collect()}
    assert [got[m] for m in (12, 1, 2, 3, 5, 6, 8, 9, 11)] == [
        "DJF", "DJF", "DJF", "MAM", "MAM", "JJA", "JJA", "SON", "SON",
    ]


@pytest.fixture(scope="module")
def six_hourly(spark):
    rows = []
    for d in (1, 2, 4):
        for h in (0, 6, 12, 18):
            value = None if d == 2 else float(d * 10 + h)
            rows.append((dt.datetime(2001, 1, d, h), 1, value))
    return spark.createDataFrame(rows, "ts timestamp_ntz, x int, value double")


def test_empty_days(six_hourly):
    mean = {r.time.day: r.value for r in resample.daily_mean(six_hourly, ["x"]).collect()}
    assert mean == {1: 19.0, 2: None, 3: None, 4: 49.0}
    total = {r.time.day: r.value for r in resample.daily_sum(six_hourly, ["x"]).collect()}
    assert total == {1: 76000.0, 2: 0.0, 3: 0.0, 4: 196000.0}
    first = {r.time.day: r.value for r in resample.daily_first(six_hourly, ["x"]).collect()}
    assert first == {1: 10.0, 2: None, 3: None, 4: 40.0}
    moved = {r.time.day: r.value for r in resample.daily_shift_one(six_hourly, ["x"]).collect()}
    assert moved == {1: None, 2: None, 3: 40.0}


def test_shift_is_by_rows(six_hourly):
    got = {r.time.day: r.value for r in resample.shift_then_daily(six_hourly, ["x"], steps=8).collect()}
    # Eight rows ahead of day 1 stands day 4: day 3 has no rows.
    assert got == {1: 196.0, 2: 0.0, 3: 0.0}


def test_month_with_a_gap(spark):
    rows = [(day(i), 0, 0, 1.0) for i in range(31)] + [(day(i), 0, 1, None if i == 3 else 1.0) for i in range(31)]
    rows += [(day(i), 0, 2, 1.0) for i in range(31) if i != 5]
    df = spark.createDataFrame(rows, "time date, y int, x int, v double")
    strict = {r.x: r.v for r in resample.monthly_sum(df, ["y", "x"], ["v"]).collect()}
    assert strict == {0: 31.0, 1: None, 2: None}
    loose = {r.x: r.v for r in resample.monthly_sum(df, ["y", "x"], ["v"], skipna=True).collect()}
    assert loose == {0: 31.0, 1: 30.0, 2: 30.0}


def plane(spark, n=4):
    return spark.createDataFrame(
        [(y, x, 2.0 * x + 3.0 * y) for y in range(n) for x in range(n)], "y int, x int, elevation double"
    )


def test_bilinear_reproduces_a_plane(spark):
    axis = spark.createDataFrame([(c,) for c in (0.0, 0.3, 1.75, 3.0)], "c double")
    out = regrid.regrid_bilinear(
        plane(spark), axis.select(F.col("c").alias("y")), axis.select(F.col("c").alias("x")), [], ["elevation"], width=2.0
    ).collect()
    assert len(out) == 16
    for r in out:
        assert math.isclose(r.elevation, 2 * r.x + 3 * r.y, abs_tol=1e-9)


def test_bilinear_outside_and_missing(spark):
    cube = plane(spark, 2).withColumn("elevation", F.when(~((F.col("y") == 0) & (F.col("x") == 0)), F.col("elevation")))
    ty = spark.createDataFrame([(0.5,), (5.0,), (1.0,)], "y double")
    tx = spark.createDataFrame([(0.5,)], "x double")
    got = {r.y: r.elevation for r in regrid.regrid_bilinear(cube, ty, tx, [], ["elevation"]).collect()}
    assert got == {0.5: None, 5.0: None, 1.0: 4.0}


def test_conservative_keeps_the_integral(spark):
    cube = plane(spark)
    cells = spark.createDataFrame([(0.0, -0.5, 0.7), (2.0, 0.7, 3.5)], "node double, lo double, hi double")
    out = regrid.regrid_conservative(cube, cells, cells, [], ["elevation"], sphere=False, width=1.0).collect()
    size = {0.0: 1.2, 2.0: 2.8}
    total = sum(r.elevation * size[r.y] * size[r.x] for r in out)
    assert math.isclose(total, sum(2 * x + 3 * y for y in range(4) for x in range(4)), rel_tol=1e-12)


def test_plane_has_one_slope_and_aspect(spark):
    for block in (2, 512):
        slopes = [r.slope for r in terrain.dem_slope(plane(spark), block=block).collect()]
        # Corners repeat the column instead of continuing it, so they are left out.
        inner = [s for s in slopes if math.isclose(s, math.degrees(math.atan(math.sqrt(13))), abs_tol=1e-9)]
        assert len(slopes) == 16 and len(inner) >= 8
    aspects = {(r.y, r.x): r.aspect for r in terrain.dem_aspect(plane(spark)).collect()}
    # Ground rises to the north-east, so it falls to the south-west.
    assert math.isclose(aspects[(1, 1)], 180 + math.degrees(math.atan2(2, 3)), abs_tol=1e-9)


def test_blocks_do_not_matter(spark):
    rough = spark.createDataFrame(
        [(y, x, float((7 * y * y + 13 * x + y * x) % 11)) for y in range(9) for x in range(7)],
        "y int, x int, elevation double",
    )
    whole = {(r.y, r.x): r.slope for r in terrain.dem_slope(rough, block=512).collect()}
    cut = {(r.y, r.x): r.slope for r in terrain.dem_slope(rough, block=3).collect()}
    assert whole == cut and len(cut) == 63


def test_flat_ground(spark):
    flat = spark.createDataFrame([(y, x, 5.0) for y in range(3) for x in range(3)], "y int, x int, elevation double")
    assert {r.slope for r in terrain.dem_slope(flat).collect()} == {0.0}
    assert {r.aspect for r in terrain.dem_aspect(flat).collect()} == {None}


def test_tiles(spark):
    with pytest.raises(ValueError):
        terrain.tile_id(plane(spark), "elevation", 3)
    plain = terrain.tile_id(plane(spark), "elevation", 2).collect()
    assert len(plain) == 16 and {r.tile for r in plain} == {0, 1, 2, 3}
    padded = terrain.tile_id(plane(spark), "elevation", 3, pad=True, cval=-1.0).collect()
    assert len(padded) == 36 and sum(r.elevation == -1.0 for r in padded) == 20
    first = {(r.row, r.col): r.elevation for r in padded if r.tile == 0}
    assert first[(0, 0)] == -1.0 and first[(1, 1)] == 0.0


def test_weights_table(spark):
    weights = spark.createDataFrame(
        [(0, 0, 9.0, 9.0, 0.25), (0, 1, 9.0, 9.0, 0.75)], "src_y int, src_x int, dst_y double, dst_x double, w double"
    )
    assert regrid.regrid_weights(plane(spark), weights, [], ["elevation"]).first().elevation == 1.5


def test_constant_truth(spark):
    df = spark.createDataFrame([(1, 2.0, 2.0), (1, 2.0, 2.0), (2, 2.0, 2.0), (2, 2.0, 3.0)], "g int, t double, p double")
    assert {r.g: r.s for r in df.groupBy("g").agg(r2("t", "p").alias("s")).collect()} == {1: 1.0, 2: 0.0}
    cube = spark.createDataFrame([(day(i), 0, 0, 4.0) for i in range(5)], "time date, y int, x int, v double")
    z = features.anomaly(cube, ["y", "x"], ["v"], standard=True)
    assert {r.v for r in z.collect()} == {None}


def ens_frame(spark, members):
    rows = [(day(0), 0, 0, m, float(v)) for m, v in enumerate(members)]
    return spark.createDataFrame(rows, "time date, y int, x int, member int, pred double")


def obs_frame(spark, v):
    return spark.createDataFrame([(day(0), 0, 0, float(v))], "time date, y int, x int, truth double")


def test_crps(spark):
    assert ensemble.crps(ens_frame(spark, [3]), obs_frame(spark, 5)).first().crps == 2.0
    members, y = [1, 1, 4, 7], 3
    pairs = sum(abs(a - b) for a in members for b in members) / 16
    want = sum(abs(m - y) for m in members) / 4 - pairs / 2
    assert math.isclose(ensemble.crps(ens_frame(spark, members), obs_frame(spark, y)).first().crps, want)


def test_rps_and_ranks(spark):
    ens, obs = ens_frame(spark, [1, 2, 3, 4]), obs_frame(spark, 2)
    # Below 1.5: share 1/4 against 0; below 3.5: share 3/4 against 1.
    assert math.isclose(ensemble.rps(ens, obs, [1.5, 3.5]).first().rps, 2 / 16)
    assert ensemble.rank_histogram(ens, obs).first().rank == 2


def test_quantile_map_identity(spark):
    rows = [(day(i), 0, 0, float((i * 37) % 50) / 3) for i in range(100)]
    df = spark.createDataFrame(rows, "time date, y int, x int, value double")
    for modified in (False, True):
        out = bias.quantile_map(df, df, df, "value", modified=modified).collect()
        assert len(out) == 100 and all(math.isclose(r.corrected, r.value, abs_tol=1e-9) for r in out)


def test_quantile_map_shift(spark):
    mod = spark.createDataFrame([(0, 0, float(i)) for i in range(11)], "y int, x int, value double")
    obs = mod.withColumn("value", F.col("value") + 5)
    out = bias.quantile_map(obs, mod, mod, "value", width=2.0).collect()
    assert all(math.isclose(r.corrected, r.value + 5) for r in out)


def test_folds_never_see_the_future(spark):
    df = spark.createDataFrame([(day(i), 0, 0) for i in range(25)], "time date, y int, x int")
    folds = splitting.split_timeseries(df, 3).collect()
    for f in (1, 2, 3):
        train = [r.time for r in folds if r.fold == f and r.part == "train"]
        test = [r.time for r in folds if r.fold == f and r.part == "test"]
        assert len(test) == 25 // 4 and max(train) < min(test)
    assert max(r.time for r in folds if r.part == "test") == day(24)


def test_stratum_shares(spark):
    df = spark.createDataFrame([(day(i), 0, 0, float(i % 3)) for i in range(100)], "time date, y int, x int, v double")
    rows = splitting.split_stratified(df, "v", 1.0).collect()
    for wet in (0, 1):
        part = [r for r in rows if r.wet == wet]
        held = sum(r.part == "valid" for r in part)
        assert abs(held - 0.2 * len(part)) <= 1


def test_strict_match_raises(spark):
    a = spark.createDataFrame([(day(0),)], "time date")
    b = spark.createDataFrame([(day(0),), (day(1),)], "time date")
    assert selection.match_time(b, a, strict=True).count() == 1
    with pytest.raises(KeyError):
        selection.match_time(a, b, strict=True)


def test_wet_days(spark):
    rows = [(day(i), 0, 0, float(i % 2) * 2, 2.0) for i in range(10)]
    rows += [(day(i), 0, 1, None if i == 0 else 2.0, 1.0) for i in range(10)]
    df = spark.createDataFrame(rows, "time date, y int, x int, truth double, pred double")
    strict = {(r.x, r.period): r for r in verification.wet_day_freq(df).collect()}
    assert strict[(0, "annual")].truth == 50.0 and strict[(0, "annual")].bias == 100.0
    assert strict[(1, "annual")].truth is None
    loose = {(r.x, r.period): r for r in verification.wet_day_freq(df, skipna=True).collect()}
    assert loose[(1, "DJF")].truth == 100.0
    amount = {r.x: r for r in verification.wet_day_intensity(df).collect()}
    assert amount[0].truth == 2.0 and amount[0].bias == 0.0 and amount[1].truth is None


def test_grid_index_pairing(spark):
    truth = spark.createDataFrame([(y, x, float(10 * y + x)) for y in (1, 5) for x in (2, 9)], "y int, x int, truth double")
    pred = spark.createDataFrame(
        [(y / 7, x / 7, float(10 * y + x)) for y in (1, 5) for x in (2, 9)], "y double, x double, pred double"
    )
    out = align.pair_on_grid_index(truth, pred, []).collect()
    assert len(out) == 4 and all(r.truth == r.pred for r in out)


def test_write_skips_a_finished_run(spark, tmp_path):
    df = spark.createDataFrame([(day(0), 0, 0, 1.0), (D(2002, 1, 1), 0, 0, 2.0)], "time date, y int, x int, pred double")
    path = str(tmp_path / "cube")
    assert files.write_cube(df, path, "a") is True
    assert files.write_cube(df.withColumn("pred", F.lit(9.0)), path, "a") is False
    back = spark.read.parquet(f"{path}/run_key=a")
    assert {r.pred for r in back.collect()} == {1.0, 2.0}
    assert {r.year for r in back.collect()} == {2001, 2002}
    assert files.write_cube(df.withColumn("pred", F.lit(9.0)), path, "a", overwrite=True) is True


def test_scan_by_year(spark, tmp_path):
    for year in (1999, 2000, 2001):
        spark.range(year - 1998).write.parquet(str(tmp_path / f"era_{year}.parquet"))
    schema = spark.range(1).schema
    out = files.scan_files(spark, str(tmp_path), r"era_\d{4}", schema, years=(2000, 2001))
    assert {(r.file_year) for r in out.collect()} == {2000, 2001} and out.count() == 5


def test_box_whiskers(spark):
    df = spark.createDataFrame([(0, float(v)) for v in (1, 2, 3, 4, 100)], "g int, value double")
    r = aggregate.box_stats(df, ["g"], "value").first()
    assert (r.q1, r.median, r.q3, r.whisker_low, r.whisker_high, r.outliers, r.n) == (2.0, 3.0, 4.0, 1.0, 4.0, 1, 5)


def test_global_trees_tell_neighbouring_cells_apart(spark):
    from gridloom.operators import forests, learning, trees

    df = spark.createDataFrame([(0.0, float(x), float(x * x)) for x in range(300) for _ in range(2)], "y double, x double, t double")
    assert learning.split_candidates(df, ["y", "x"]) == 300 and learning.split_candidates(df, ["t"]) == 255
    one = {"rounds": 1, "rate": 1.0, "limits": trees.Growth(depth=30)}
    model = learning.fit_global(df, ["y", "x"], ["y", "x"], "t", "XGBRegressor", **one)
    assert forests.predict(df, model).filter(F.abs(F.col("predicted") - F.col("t")) > 1e-6).count() == 0


def test_global_forests_are_registered_without_a_limit():
    from gridloom.operators import learning, trees

    assert learning.GLOBAL["RandomForestRegressor"][1] == {"trees": 100, "limits": trees.Growth(None, None, 1.0)}
