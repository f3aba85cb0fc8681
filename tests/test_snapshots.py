"""Published snapshots and the correlation matrix."""

import datetime as dt
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.operators import aggregate
from gridloom.sources import snapshots


def cube(spark, value):
    rows = [(dt.date(2001 + i % 3, 1, 1 + i), i, float(value)) for i in range(12)]
    return spark.createDataFrame(rows, "time date, y int, pred double")


def seen(spark, path, **named):
    return {r.pred for r in snapshots.read_published(spark, path, **named).collect()}


def test_a_failed_run_leaves_the_old_one(spark, tmp_path):
    path = str(tmp_path / "cubes")
    with pytest.raises(FileNotFoundError):
        snapshots.read_published(spark, path)
    assert snapshots.publish_cube(cube(spark, 1), path, "a") is True
    assert snapshots.publish_cube(cube(spark, 2), path, "a") is False
    broken = cube(spark, 3).repartition(4).withColumn("pred", F.when(F.col("y") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("pred")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        snapshots.publish_cube(broken, path, "a", overwrite=True)
    assert seen(spark, path) == {1.0} and snapshots.read_published(spark, path).count() == 12
    reader = snapshots.read_published(spark, path)
    assert snapshots.publish_cube(cube(spark, 4), path, "a", overwrite=True) is True
    assert {r.pred for r in reader.collect()} == {1.0}  # a reader under way keeps its version
    assert seen(spark, path) == {4.0} and seen(spark, path, version=1) == {1.0}
    assert snapshots.publish_cube(cube(spark, 5).limit(0), path, "b") is True
    assert snapshots.prune(spark, path, "a", keep=1) == 1 and snapshots.prune(spark, path, "a", keep=1) == 0
    assert len(snapshots.versions(spark, path, "a")) == 1 and seen(spark, path, run_keys=["a"]) == {4.0}


def test_correlation_of_pairs_that_are_there(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(rng.normal(1e6, 1, (400, 4)), columns=list("abcd"))
    pdf["b"] += 0.7 * pdf["a"]
    pdf["c"] = np.where(rng.uniform(size=400) < 0.4, np.nan, pdf["c"] + pdf["b"])
    pdf["same"], pdf["none"] = 0.1, np.nan
    names = list(pdf.columns)
    want = pdf.corr(min_periods=2)
    for parts in (1, 7):
        rows = spark.createDataFrame(pdf).repartition(parts)
        got = {(r.a, r.b): r.r for r in aggregate.correlation_matrix(rows, names).collect()}
        assert set(got) == {(names[i], names[j]) for i, j in itertools.product(range(6), repeat=2) if j < i}
        for (a, b), r in got.items():
            if {a, b} & {"same", "none"}:
                assert r is None
            else:
                assert r == pytest.approx(want.loc[a, b], abs=1e-9)
    assert aggregate.correlation_matrix(spark.createDataFrame(pdf).limit(0), names).count() == 0
