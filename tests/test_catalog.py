"""Every registered query against its SQL twin on the smallest tables."""

import glob
import os
import sys

import duckdb
import pytest

from tests.conftest import SF

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import compare  # noqa: E402

import __spark_entry__ as entry_point  # noqa: E402

QUERIES, SQL = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("key", sorted(SQL))
def test_matches_sql(spark, db, key):
    df = QUERIES[key](spark, SF)
    cur = db.execute(SQL[key])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    got = compare.rows([tuple(x) for x in df.collect()], df.columns)
    assert got == compare.rows(cur.fetchall(), names)


LEARNED = [
    "fit_predict_cells",
    "fit_predict_ensemble_forest",
    "global_rf",
    "global_gbt_leafwise",
    "global_adaboost",
    "glm_tweedie_gamma",
    "glm_tweedie_cells",
]


@pytest.mark.parametrize("key", LEARNED)
def test_learned_query_has_predictions(spark, key):
    rows = QUERIES[key](spark, SF).collect()
    assert rows and any(r["predicted"] is not None for r in rows)


def test_importance_sums_to_one(spark):
    shares = [r["importance"] for r in QUERIES["feature_importance"](spark, SF).collect()]
    assert abs(sum(shares) - 1) < 1e-3


def test_kmeans_labels_every_cell(spark):
    rows = QUERIES["kmeans_regions"](spark, SF).collect()
    assert {r["region"] for r in rows} <= set(range(6)) and all(r["region"] is not None for r in rows)


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["bias", "mae", "rmse"] and df.count() == 1
