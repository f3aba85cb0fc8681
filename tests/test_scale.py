"""Skew-safe building blocks and learners against brute force."""

import math
from itertools import product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.operators.metric import near_balls
from gridloom.operators import learning, linear, ranks, regions, splitting, trees
from gridloom.sources.workspace import fresh_path


def skewed(spark, n=30000, seed=1):
    """One group holds most rows, with many copies of one value."""
    rng = np.random.default_rng(seed)
    g = np.where(rng.random(n) < 0.7, 0, rng.integers(1, 5, n))
    v = np.where(rng.random(n) < 0.3, 0.0, rng.gamma(0.5, 20.0, n))
    pdf = pd.DataFrame({"g": g, "v": v, "i": np.arange(n)})
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_exact_quantiles(spark, keys):
    pdf, df = skewed(spark)
    probs = [0.0, 0.02, 0.25, 0.5, 0.9, 0.98, 1.0]
    got = ranks.exact_quantiles(df, keys, "v", probs, margin=0.01, small=500, pieces=7).collect()
    groups = [((), pdf)] if not keys else [((k,), part) for k, part in pdf.groupby("g")]
    assert len(got) == len(groups) * len(probs)
    table = {(tuple(r[k] for k in keys), r.prob): r.q for r in got}
    for key, part in groups:
        for p in probs:
            assert math.isclose(table[(key, p)], np.quantile(part.v, p), rel_tol=1e-12, abs_tol=1e-12)


def test_quantiles_of_tiny_groups(spark):
    pdf = pd.DataFrame([(g, float(v)) for g in range(1, 9) for v in range(g)], columns=["g", "v"])
    got = ranks.exact_quantiles(spark.createDataFrame(pdf), ["g"], "v", [0.1, 0.5, 0.9]).collect()
    for r in got:
        assert math.isclose(r.q, np.quantile(pdf[pdf.g == r.g].v, r.prob), abs_tol=1e-12)


def test_positions_and_running_total(spark):
    pdf, df = skewed(spark, 3000)
    got = ranks.positions(df, ["g"], ["v", "i"], ranks.value_chunk("v", 5.0)).toPandas()
    want = pdf.sort_values(["v", "i"]).groupby("g").cumcount() + 1
    assert (got.set_index("i").pos.sort_index() == want.sort_index()).all()
    with_peers = ranks.running_total(df, ["g"], ["v"], ranks.value_chunk("v", 5.0), F.lit(1), "n", peers=True).toPandas()
    part = pdf[pdf.g == 1].v.to_numpy()
    for r in with_peers[with_peers.g == 1].itertuples():
        assert r.n == (part <= r.v).sum()


@pytest.mark.parametrize("block", [6, 7, 65536])
def test_lead_over_block_borders(spark, block):
    pdf, df = skewed(spark, 400)
    chunk = F.floor(F.col("i") / 37)
    got = ranks.lead_rows(df, ["g"], ["i"], chunk, ["v"], 6, block=block).toPandas().set_index("i").v.sort_index()
    want = pdf.groupby("g").v.shift(-6)
    assert len(got) == len(pdf)
    assert np.allclose(got.to_numpy(dtype=float), want.to_numpy(), equal_nan=True)


def dbscan_brute(points, eps, least):
    """Textbook density clustering with clusters named by their smallest core point."""
    ids = sorted(points)
    near = {
        i: [j for j in ids if sum((a - b) ** 2 for a, b in zip(points[i], points[j])) <= eps * eps] for i in ids
    }
    core = {i for i in ids if len(near[i]) >= least}
    name = {}
    for i in sorted(core):
        if i in name:
            continue
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in name:
                name[j] = i
                todo += [k for k in near[j] if k in core]
    out = dict(name)
    for i in ids:
        if i not in core:
            out[i] = min((name[j] for j in near[i] if j in core), default=-1)
    return out


@pytest.mark.parametrize("seed,dims", [(0, 2), (2, 1), (3, 4)])
def test_dbscan_against_brute_force(spark, seed, dims):
    rng = np.random.default_rng(seed)
    blob = rng.normal(0, 0.15, (120, dims))
    ring = rng.uniform(-3, 3, (100, dims))
    copies = np.repeat([[1.5] * dims], 80, axis=0)
    line = np.column_stack([np.linspace(-2, 2, 60)] + [np.full(60, 2.5)] * (dims - 1))
    pts = np.concatenate([blob, ring, copies, line])
    names = [f"c{i}" for i in range(dims)]
    pdf = pd.DataFrame(pts, columns=names).assign(id=np.arange(len(pts)))
    got = {r.id: r.cluster for r in regions.dbscan(spark.createDataFrame(pdf), "id", names, 0.3, 5).collect()}
    assert got == dbscan_brute({i: tuple(p) for i, p in enumerate(pts)}, 0.3, 5)


def test_dbscan_on_64_features(spark):
    rng = np.random.default_rng(8)
    middles = rng.uniform(0, 1, (6, 64))
    pts = np.concatenate([middles[rng.integers(0, 6, 380)] + rng.normal(0, 0.03, (380, 64)), rng.uniform(0, 1, (60, 64)), np.repeat(middles[:1], 60, axis=0)])
    names = [f"c{i}" for i in range(64)]
    pdf = pd.DataFrame(pts, columns=names).assign(id=np.arange(len(pts)))
    got = {r.id: r.cluster for r in regions.dbscan(spark.createDataFrame(pdf), "id", names, 0.3, 5).collect()}
    assert got == dbscan_brute({i: tuple(p) for i, p in enumerate(pts)}, 0.3, 5)
    assert len(set(got.values())) == 7


def test_metric_index_loses_no_pair(spark):
    rng = np.random.default_rng(3)
    at = np.concatenate([rng.normal(0, 1, (300, 5)), rng.normal(4, 0.1, (200, 5)), np.repeat([[9.0] * 5], 90, axis=0)])
    r = rng.uniform(0, 0.1, len(at))
    asks = rng.uniform(0, 1, len(at)) < 0.6
    rows = [(i, [float(x) for x in p], float(q), bool(a)) for i, (p, q, a) in enumerate(zip(at, r, asks))]
    balls = spark.createDataFrame(rows, "key int, at array<double>, r double, asks boolean")
    got = [(p.a, p.b) for p in near_balls(balls, 0.3, leaf=20, fan=4).collect()]
    apart = np.sqrt(((at[:, None] - at[None]) ** 2).sum(2))
    want = {(i, j) for i, j in zip(*np.where(apart <= 0.3 + r[:, None] + r[None])) if i != j and asks[i]}
    assert len(got) == len(set(got)) and set(got) == want
    assert near_balls(balls.limit(0), 0.3).count() == 0


def cells(spark, n=240):
    rng = np.random.default_rng(5)
    rows = []
    for y, x in product(range(2), range(2)):
        a = rng.uniform(-3, 3, n)
        b = rng.uniform(-3, 3, n)
        target = np.where(a > 0, 4.0, -4.0) + (y - x) * b + rng.normal(0, 0.2, n)
        rows += [(y, x, i, float(a[i]), float(b[i]), float(target[i])) for i in range(n)]
    return spark.createDataFrame(rows, "y int, x int, step int, a double, b double, truth double")


@pytest.mark.parametrize(
    "learner,settings",
    [
        ("RandomForestRegressor", {}),
        ("LGBMRegressor", {}),
        ("XGBRegressor", {}),
        ("AdaBoostRegressor", {}),
    ],
)
def test_learners_beat_the_mean(spark, learner, settings):
    df = cells(spark)
    train, test = df.filter("step < 180"), df.filter("step >= 180")
    models = learning.fit_cells(train, ["y", "x"], ["a", "b"], "truth", learner, order="step", **settings)
    path = fresh_path(spark, "m")
    learning.save_models(models, path, "run")
    models = learning.load_models(spark, path, "run")
    out = trees.predict(test, models, ["y", "x"], ["a", "b"]).toPandas()
    assert len(out) == 240 and out.predicted.notna().all()
    for _, part in out.groupby(["y", "x"]):
        error = ((part.predicted - part.truth) ** 2).mean()
        assert error < 0.5 * part.truth.var()


def test_one_tree_finds_the_step(spark):
    df = cells(spark).filter("y = 0 and x = 0")
    one = {"rounds": 1, "rate": 1.0, "limits": trees.Growth(depth=1)}
    model = learning.fit_cells(df, ["y", "x"], ["a", "b"], "truth", "LGBMRegressor", "step", **one).first()
    tree = np.frombuffer(model.trees[0], trees.NODE)
    assert tree["feature"][0] == 0 and abs(tree["at"][0]) < 0.2
    leaves = model.base + tree["value"][1:]
    assert np.allclose(sorted(leaves), [-4, 4], atol=0.5)


def test_limits_of_a_tree():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(500, 3)), rng.normal(size=500)
    data, ones, everything = trees.Binned(x, 40), np.ones(500), np.arange(3)
    for limits in (trees.Growth(leaves=7), trees.Growth(depth=2), trees.Growth(min_rows=60)):
        tree = trees.grow(data, y, ones, limits, everything)
        leaf = tree["feature"] < 0
        assert limits.leaves is None or leaf.sum() == limits.leaves
        assert limits.depth is None or leaf.sum() <= 2**limits.depth
        counts = np.unique(trees.applied(np.array([(n["feature"], n["left"], n["right"], n["at"], i) for i, n in enumerate(tree)], trees.NODE), x), return_counts=True)[1]
        assert counts.min() >= limits.min_rows
    full = trees.grow(trees.Binned(x, 1000), y, ones, trees.Growth(), everything)
    assert np.allclose(trees.applied(full, x), y)
    only = trees.grow(data, y, ones, trees.Growth(), np.array([1]))
    assert set(only["feature"]) <= {-1, 1}
    assert len(trees.grow(data, y, ones, trees.Growth(l1=1e9), everything)) == 1


def test_trees_that_grow_together_equal_single_ones():
    rng = np.random.default_rng(8)
    x, y = np.round(rng.normal(size=(200, 3)), 1), rng.normal(size=200)
    data, weights = trees.Binned(x, 30), rng.integers(0, 3, size=(5, 200)).astype(float)
    for limits in (trees.Growth(), trees.Growth(depth=3, min_rows=9.0), trees.Growth(l1=0.5, l2=1.0)):
        together = trees.grow_together(data, y, weights, limits)
        for tree, weight in zip(together, weights, strict=True):
            single = trees.grow(data, y, weight, limits, np.arange(3))
            assert len(single) == len(tree) and np.allclose(trees.applied(single, x), trees.applied(tree, x))


def test_boosting_stops_early():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2))
    y = x[:, 0] + rng.normal(size=300)
    model = trees.boosted(x[:200], y[:200], rng, rounds=20_000, rate=0.1, valid=(x[200:], y[200:]), patience=20)
    assert 1 <= len(model["trees"]) < 500


def test_tune_scores_every_trial(spark):
    df = cells(spark, 120).withColumnRenamed("step", "time")
    df = df.withColumn("part", F.when(F.col("time") < 90, "train").otherwise("valid"))
    trials = learning.tune(df, ["y", "x"], ["a", "b"], "truth", trials=6, rounds=30, patience=10).collect()
    assert sorted(t.number for t in trials) == [1, 2, 3, 4, 5, 6]
    assert all(t.cells == 4 and t.value > 0 and t.rounds <= 30 for t in trials)
    assert all(t.params_depth in learning.DEPTHS and t.params_rate in learning.RATES for t in trials)
    assert all(1 <= t.params_num_leaves <= 1000 and 1 <= t.params_min_rows <= 300 for t in trials)


def test_cross_validation_of_cells(spark):
    df = cells(spark).withColumn("time", F.date_add(F.lit("2001-01-01").cast("date"), F.col("step")))
    out = learning.cross_validate_cells(df, ["y", "x"], ["a", "b"], "truth", "LGBMRegressor", folds=10).collect()
    assert len(out) == 4 and all(r.folds == 10 and 0 < r.rmse < 3 for r in out)


def test_unknown_learner(spark):
    with pytest.raises(ValueError):
        learning.fit_cells(cells(spark), ["y", "x"], ["a"], "truth", "Nope")


@pytest.mark.parametrize("learner", ["RandomForestRegressor", "LGBMRegressor", "XGBRegressor", "AdaBoostRegressor"])
def test_same_model_for_any_partitioning(spark, learner):
    df = cells(spark, 60)

    def fit(frame):
        models = learning.fit_cells(frame, ["y", "x"], ["a", "b"], "truth", learner, "step")
        out = trees.predict(df, models, ["y", "x"], ["a", "b"])
        return [round(r.predicted, 9) for r in out.orderBy("y", "x", "step").collect()]

    assert fit(df.coalesce(1)) == fit(df.repartition(4))


def test_missing_predictors_give_null(spark):
    df = cells(spark, 40)
    models = learning.fit_cells(df.filter("x = 0"), ["y", "x"], ["a", "b"], "truth", "LGBMRegressor", "step")
    asked = df.withColumn("a", F.when(F.col("step") > 2, F.col("a")))
    out = trees.predict(asked, models, ["y", "x"], ["a", "b"]).collect()
    assert len(out) == 160 and all((r.predicted is None) == (r.step <= 2 or r.x == 1) for r in out)


def test_ridge_against_numpy(spark):
    df = cells(spark)
    model = {(r.y, r.x): r.coef for r in linear.fit_ridge(df, ["y", "x"], ["a", "b"], "truth").collect()}
    for (y, x), part in df.toPandas().groupby(["y", "x"]):
        design = np.column_stack([part.a, part.b, np.ones(len(part))])
        want = np.linalg.lstsq(design, part.truth, rcond=None)[0]
        assert np.allclose(model[(y, x)], want)


def test_gamma_model(spark):
    rng = np.random.default_rng(3)
    a = rng.uniform(0, 2, 400)
    y = np.exp(0.5 + 0.8 * a) * rng.gamma(50, 1 / 50, 400)
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "a": a, "truth": y}))
    coef = linear.fit_glm_cells(df, ["g"], ["a"], "truth", power=2, penalty=1e-9).first().coef
    assert abs(coef[0] - 0.8) < 0.05 and abs(coef[1] - 0.5) < 0.05


def test_nearest_centroid_ties(spark):
    centroids = spark.createDataFrame([(2, 0.0), (1, 2.0)], "region int, a double")
    df = spark.createDataFrame([(0.1,), (1.0,), (3.0,)], "a double")
    got = {r.a: r.region for r in regions.kmeans_assign(df, centroids, ["a"]).collect()}
    assert got == {0.1: 2, 1.0: 1, 3.0: 1}


def test_sampling_is_reproducible(spark):
    df = spark.createDataFrame([(y, x) for y in range(20) for x in range(30)], "y int, x int")
    a = {(r.y, r.x) for r in splitting.sample_cells(df, 4).collect()}
    b = {(r.y, r.x) for r in splitting.sample_cells(df.repartition(3), 4).collect()}
    assert a == b and len(a) == 16
    drawn = splitting.sample_cells_repeat(df, 5).collect()
    assert sorted((r.iy, r.ix) for r in drawn) == sorted(product(range(1, 6), range(1, 6)))


def test_quantile_map_keeps_every_row(spark):
    from gridloom.operators import bias

    frame = lambda rows: spark.createDataFrame(rows, "y int, x int, value double")
    calib = frame([(0, 0, float(v)) for v in range(10)])
    later = frame([(0, 0, 3.0), (0, 0, None), (5, 5, 1.0)])
    out = bias.quantile_map(calib, calib, later, "value").collect()
    assert sorted((r.y, r.value or -1, r.corrected) for r in out if r.corrected is not None) == [(0, 3.0, 3.0)]
    assert len(out) == 3 and sum(r.corrected is None for r in out) == 2


def test_kmeans_keeps_cells_that_are_not_valid(spark):
    df = spark.createDataFrame([(i, float(i % 2), None if i == 3 else 1.0) for i in range(8)], "i int, a double, ok double")
    out = {r.i: r.region for r in regions.kmeans_regions(df, ["a"], 2, valid="ok").collect()}
    assert len(out) == 8 and out[3] is None and out[0] != out[1]
