"""Remapping from curved grids: planes, rotated and wrapped grids, areas, and the rectilinear operator as a yardstick."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import curvilinear as C
from gridloom.operators import regrid


def grid(spark, ny, nx, place):
    return spark.createDataFrame([(y, x, *map(float, place(y, x))) for y in range(ny) for x in range(nx)], "y int, x int, lat double, lon double")


def rotated(y, x, angle=0.4, step=0.7):
    return 40 + step * (y * np.cos(angle) + x * np.sin(angle)), 8 + step * (x * np.cos(angle) - y * np.sin(angle))


def curved(y, x):
    return 40 + 0.5 * y + 0.02 * x * x, 8 + 0.6 * x - 0.03 * y * x


def remapped(spark, nodes, points, value):
    cube = nodes.select(F.lit(1).alias("time"), "y", "x", value.alias("v"))
    targets = spark.createDataFrame([(float(a), float(b), float(a), float(b)) for a, b in points], "dst_y double, dst_x double, lat double, lon double")
    out = C.regrid_curvilinear(cube, C.bilinear_weights(nodes, targets), ["time"], ["v"])
    return {(r["y"], r["x"]): r["v"] for r in out.collect()}


@pytest.mark.parametrize("place", [rotated, curved, lambda y, x: (-3 + y, 2 + x)])
def test_a_plane_is_reproduced(spark, place):
    nodes = grid(spark, 9, 11, place)
    rng = np.random.default_rng(1)
    corners = np.array([[place(y, x) for x in range(11)] for y in range(9)])
    i, j, t, s = rng.integers(0, 8, 200), rng.integers(0, 10, 200), rng.random(200)[:, None], rng.random(200)[:, None]
    points = (1 - t) * ((1 - s) * corners[i, j] + s * corners[i, j + 1]) + t * ((1 - s) * corners[i + 1, j] + s * corners[i + 1, j + 1])
    points = [*points.tolist(), *corners[::2, ::3].reshape(-1, 2).tolist()]  # nodes themselves too
    got = remapped(spark, nodes, points, 3 * F.col("lat") - 2 * F.col("lon") + 5)
    assert len(got) == len(points)
    assert all(abs(v - (3 * lat - 2 * lon + 5)) < 1e-9 for (lat, lon), v in got.items())


def test_across_the_date_line_and_outside(spark):
    nodes = grid(spark, 4, 6, lambda y, x: (10.0 + y, (177.5 + x + 180) % 360 - 180))
    got = remapped(spark, nodes, [(11.5, 179.75), (11.5, -179.75), (11.5, 180.25), (50.0, 0.0), (11.5, 170.0)], F.col("y") + 10.0 * F.col("x"))
    assert got == pytest.approx({(11.5, 179.75): 24.0, (11.5, -179.75): 29.0, (11.5, 180.25): 29.0, (50.0, 0.0): None, (11.5, 170.0): None})


def test_a_missing_corner_is_missing_unless_it_has_no_weight(spark):
    nodes = grid(spark, 3, 3, rotated)
    hole = F.when((F.col("y") == 0) & (F.col("x") == 0), None).otherwise(F.lit(1.0))
    inside, beside = np.mean([rotated(0, 0), rotated(1, 1)], 0), np.mean([rotated(1, 1), rotated(2, 2)], 0)
    got = list(remapped(spark, nodes, [inside, beside, rotated(0, 1)], hole).values())
    assert sorted(map(str, got)) == ["1.0", "1.0", "None"]


def target_cells(spark, lats, lons):
    rows = [((a + b) / 2, (c + d) / 2, [(a, c), (a, d), (b, d), (b, c)]) for a, b in zip(lats, lats[1:]) for c, d in zip(lons, lons[1:])]
    return spark.createDataFrame(rows, "dst_y double, dst_x double, corners array<struct<lat:double,lon:double>>")


def test_areas_are_kept(spark):
    nodes = grid(spark, 8, 9, curved)
    source = C.cells(nodes)
    assert source.count() == 72
    target = target_cells(spark, np.arange(38, 48, 0.9).tolist(), np.arange(5, 16, 1.3).tolist())
    weights = C.conservative_weights(source, target).cache()
    own = source.select("y", "x", C.signed_area(C.flattened(F.col("corners"))).alias("area"))
    sums = weights.groupBy("src_y", "src_x").agg(F.sum("w").alias("w"))
    far = own.join(sums, (F.col("y") == F.col("src_y")) & (F.col("x") == F.col("src_x"))).select(F.max(F.abs(F.col("w") - F.col("area"))), F.count("*")).first()
    assert far[0] < 1e-9 and far[1] == 72  # the target covers the source, so every cell is dealt out whole
    cube = nodes.select("y", "x", (F.col("y") * 3.0 + F.col("x")).alias("v"))
    before = cube.join(own, ["y", "x"]).agg(F.sum(F.col("v") * F.col("area"))).first()[0]
    covered = weights.groupBy(F.col("dst_y").alias("y"), F.col("dst_x").alias("x")).agg(F.sum("w").alias("area"))
    after = C.regrid_curvilinear_conservative(cube, weights, [], ["v"]).join(covered, ["y", "x"]).agg(F.sum(F.col("v") * F.col("area"))).first()[0]
    assert after == pytest.approx(before, rel=1e-10)


def test_conservative_equals_the_rectilinear_operator(spark):
    nodes = grid(spark, 6, 7, lambda y, x: (30 + 1.5 * y, (176 + 1.2 * x + 180) % 360 - 180))
    lats, lons = [30.0, 31.9, 35.0, 38.3], [175.9, 178.0, 180.5, 183.0]
    weights = C.conservative_weights(C.cells(nodes), target_cells(spark, lats, lons))
    cube = nodes.select("y", "x", (F.col("y") * 7.0 + F.col("x") * F.col("x")).alias("v"))
    got = {(r["y"], r["x"]): r["v"] for r in C.regrid_curvilinear_conservative(cube, weights, [], ["v"]).collect()}
    axis = lambda e: spark.createDataFrame([((a + b) / 2, a, b) for a, b in zip(e, e[1:])], "node double, lo double, hi double")
    plain = cube.select((30 + 1.5 * F.col("y")).alias("y"), (176 + 1.2 * F.col("x")).alias("x"), "v")
    want = {(r["y"], r["x"]): r["v"] for r in regrid.regrid_conservative(plain, axis(lats), axis(lons), [], ["v"]).collect()}
    assert got == pytest.approx(want, rel=1e-9) and len(got) == 9


def test_clipping_against_known_shapes(spark):
    ring = lambda pts: F.array(*[F.struct(F.lit(float(u)).alias("u"), F.lit(float(v)).alias("v")) for u, v in pts])
    square = [(0, 0), (2, 0), (2, 2), (0, 2)]
    cases = [([(1, 1), (3, 1), (3, 3), (1, 3)], 1.0), ([(0.5, 0.5), (1, 0.5), (1, 1), (0.5, 1)], 0.25), ([(1, -1), (3, 1), (1, 3), (-1, 1)], 4.0), ([(5, 5), (6, 5), (6, 6)], 0.0), ([(-9, -9), (9, -9), (9, 9), (-9, 9)], 4.0)]
    for points, area in cases:
        assert spark.range(1).select(C.signed_area(C.clipped(ring(points), ring(square)))).first()[0] == pytest.approx(area)


def test_empty_grids(spark):
    nodes = grid(spark, 3, 3, rotated)
    targets = spark.createDataFrame([(1.0, 1.0, 41.0, 8.0)], "dst_y double, dst_x double, lat double, lon double")
    assert C.bilinear_weights(nodes, targets.where("false")).count() == 0
    assert C.bilinear_weights(nodes.where("false"), targets).where("w is not null").count() == 0
    assert C.cells(nodes.where("false")).count() == 0
