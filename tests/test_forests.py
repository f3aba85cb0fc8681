"""Distributed histogram trees against trees grown in one place, and their limits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import forests
from gridloom.operators.trees import Growth

X, KEYS = ["a", "b", "c"], ["time", "y", "x"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    n = 1500
    a, b, c = rng.normal(size=n), rng.integers(0, 6, n), np.ones(n)
    target = np.where(a > 0.3, 4.0, -1.0) * (1 + b % 3) + rng.normal(size=n) * 0.1
    data = [(i // 25, i % 5, i // 5 % 5, float(a[i]), float(b[i]), float(c[i]), float(target[i])) for i in range(n)]
    data += [(900, 0, 0, None, 1.0, 1.0, 2.0), (901, 0, 0, 1.0, 1.0, 1.0, None)]
    return spark.createDataFrame(data, "time int, y int, x int, a double, b double, c double, target double").repartition(5)


def values(df):
    return {tuple(r[k] for k in KEYS): r["predicted"] for r in df.collect()}


@pytest.mark.parametrize("limits", [Growth(depth=3, l1=0.5, l2=1.0), Growth(leaves=7, min_rows=20.0), Growth(leaves=5, depth=3)])
def test_boosted_is_the_same_by_histograms_and_in_one_place(rows, limits):
    fit = lambda df, finish: forests.fit_boosted(df, KEYS, X, "target", rounds=3, rate=0.5, subsample=0.8, columns=0.7, limits=limits, exact=["b"], finish=finish)
    one, many = fit(rows, 10**9), fit(rows, 0)
    assert values(forests.predict(rows, one)) == pytest.approx(values(forests.predict(rows, many)), abs=1e-9)
    again = fit(rows.repartition(1), 0)
    assert [t.tobytes() for t in again.whole] == [t.tobytes() for t in many.whole]  # whatever the partitions


def test_forest_is_the_same_wherever_subtrees_begin(rows, monkeypatch):
    fit = lambda finish: forests.fit_forest(rows, KEYS, X, "target", trees=5, finish=finish)
    whole, some = fit(10**9), fit(150)
    assert any(len(t.nodes) > 1 for t in some.trees) and some.subtrees is not None
    got = values(forests.predict(rows, whole))
    assert got == pytest.approx(values(forests.predict(rows, some)), abs=1e-9)
    monkeypatch.setattr(forests, "SHARE", 40)  # crowded nodes in many shares
    assert got == pytest.approx(values(forests.predict(rows, some)), abs=1e-9)
    assert got[(900, 0, 0)] is None and got[(901, 0, 0)] is not None
    share = {r["feature"]: r["importance"] for r in forests.importances(rows, some).collect()}
    assert share == pytest.approx({r["feature"]: r["importance"] for r in forests.importances(rows, whole).collect()}, abs=1e-6)
    assert sum(share.values()) == pytest.approx(1) and share["c"] == 0 and share["a"] > share["b"] > 0.1
    error = rows.join(forests.predict(rows, some).select(*KEYS, "predicted"), KEYS).agg(F.avg((F.col("predicted") - F.col("target")) ** 2)).first()[0]
    assert error < 0.3  # the variance of the target is about 25


def test_histograms_in_blocks(rows, monkeypatch):
    fit = lambda: forests.fit_boosted(rows, KEYS, X, "target", rounds=1, limits=Growth(depth=4), finish=0).whole[0].tobytes()
    expected = fit()
    monkeypatch.setattr(forests, "CELLS", 800)  # one node a pass
    assert fit() == expected


def test_early_stop_keeps_the_best_round(rows):
    noise = rows.withColumn("target", F.col("target") + F.randn(5) * 8)
    valid = noise.where("time >= 40")
    model = forests.fit_boosted(noise.where("time < 40"), KEYS, X, "target", rounds=60, rate=0.5, limits=Growth(depth=5), valid=valid, patience=5)
    error = lambda k: valid.join(forests.predict(valid, forests.Model(X, model.cuts, model.trees[:k], model.base, model.rate, None, model.whole[:k])).select(*KEYS, "predicted"), KEYS).agg(F.avg((F.col("predicted") - F.col("target")) ** 2)).first()[0]
    assert len(model.whole) < 60
    assert error(len(model.whole)) <= min(error(k) for k in range(1, len(model.whole))) + 1e-9


def test_nothing_to_learn_from(rows):
    assert forests.fit_forest(rows.where("false"), KEYS, X, "target") is None
    same = rows.withColumn("target", F.lit(3.0))
    for finish in (0, 10**9):
        model = forests.fit_boosted(same, KEYS, X, "target", rounds=2, finish=finish)
        assert set(values(forests.predict(same.where("a is not null"), model)).values()) == {3.0}
    with pytest.raises(ValueError):
        forests.fit_boosted(rows, KEYS, X, "target", limits=Growth())
