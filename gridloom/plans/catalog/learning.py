"""Learning: per-cell and global models, tuning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gridloom.operators import features, forests, learning, linear, splitting, trees
from gridloom.operators import verification as V
from gridloom.plans.catalog.base import BOOKED, ENS, MONTHLY_TRUTH, PAIR, RAIN, d, query, r
from gridloom.plans.catalog.verification import r2_sql
from gridloom.sources import cellstore, tables
from gridloom.sources.workspace import fresh_path, stored

CELL = ["y", "x"]
KEYS = ["time", "y", "x"]
X = ["pred", "doy_sin", "doy_cos"]  # `refe` is made from the target, so it is no predictor
_SPLIT = "1999-01-01"
_DAY = f"date '{_SPLIT}'"


def _cube(spark, sf, **period):
    return features.doy_encode(tables.pair(spark, sf, **period))


def _train(spark, sf):
    return stored(_cube(spark, sf, end=_SPLIT))


def _test(spark, sf):
    return _cube(spark, sf, start=_SPLIT)


_LINES = f"""lines as (select y, x, regr_slope(truth, pred) as b, regr_intercept(truth, pred) as a
  from pair where time < {_DAY} and truth is not null group by 1, 2)"""


@query(
    "fit_cell_linear",
    f"with {PAIR}, {_LINES} select y, x, {r('b')} as slope, {r('a')} as intercept from lines",
)
def fit_cell_linear(spark, sf):
    return linear.fit_cell_linear(tables.pair(spark, sf, end=_SPLIT), CELL, "pred", "truth")


@query(
    "fit_predict_cells_linear",
    f"""with {PAIR}, {_LINES} select {d('time')} as time, y, x, {r('truth')} as truth, {r('a + b * pred')} as predicted
      from pair join lines using (y, x) where time >= {_DAY}""",
)
def fit_predict_cells_linear(spark, sf):
    model = linear.fit_cell_linear(tables.pair(spark, sf, end=_SPLIT), CELL, "pred", "truth")
    later = tables.pair(spark, sf, start=_SPLIT).select(*KEYS, "truth", "pred")
    return linear.predict_linear(later, model, CELL, "pred", "predicted").drop("pred")


_TWO = f"""m as (select y, x, avg(pred) as mp, avg(refe) as mr, avg(truth) as mt, covar_pop(pred, pred) as pp,
    covar_pop(pred, refe) as pr, covar_pop(refe, refe) as rr, covar_pop(pred, truth) as pt, covar_pop(refe, truth) as rt
  from pair where time < {_DAY} and truth is not null group by 1, 2),
s as (select *, (pp + 0.5) * (rr + 0.5) - pr * pr as det from m),
c as (select y, x, mp, mr, mt, ((rr + 0.5) * pt - pr * rt) / det as bp, ((pp + 0.5) * rt - pr * pt) / det as br from s)"""


@query(
    "fit_predict_cells_ridge",
    f"""with {PAIR}, {_TWO} select {d('time')} as time, y, x, {r('truth')} as truth,
      {r('mt + bp * (pred - mp) + br * (refe - mr)')} as predicted from pair join c using (y, x) where time >= {_DAY}""",
)
def fit_predict_cells_ridge(spark, sf):
    both = ["pred", "refe"]
    model = linear.fit_ridge(tables.pair(spark, sf, end=_SPLIT), CELL, both, "truth", penalty=0.5)
    later = tables.pair(spark, sf, start=_SPLIT)
    return linear.predict_ridge(later, model, CELL, both, "predicted").select(*KEYS, "truth", "predicted")


def _fit_predict(spark, sf, learner):
    models = learning.fit_cells(_train(spark, sf), CELL, X, "truth", learner)
    return trees.predict(_test(spark, sf), models, CELL, X).select(*KEYS, "truth", "predicted")


@query("fit_predict_cells")
def fit_predict_cells(spark, sf):
    return _fit_predict(spark, sf, "RandomForestRegressor")


@query("fit_predict_cells_boosted")
def fit_predict_cells_boosted(spark, sf):
    return _fit_predict(spark, sf, "LGBMRegressor")


@query("fit_predict_cells_levelwise")
def fit_predict_cells_levelwise(spark, sf):
    return _fit_predict(spark, sf, "XGBRegressor")


@query("fit_predict_cells_adaboost")
def fit_predict_cells_adaboost(spark, sf):
    return _fit_predict(spark, sf, "AdaBoostRegressor")


@query(
    "fit_predict_ensemble",
    f"""with {MONTHLY_TRUTH}, {ENS}, em as (select time, y, x, avg(pred) as pred from ens group by 1, 2, 3),
      lines as (select y, x, regr_slope(truth, pred) as b, regr_intercept(truth, pred) as a
        from em join obs using (time, y, x) where time < {_DAY} and truth is not null group by 1, 2)
      select {d('time')} as time, y, x, member, {r('a + b * pred')} as predicted from ens join lines using (y, x)
      where time >= {_DAY}""",
)
def fit_predict_ensemble(spark, sf):
    calib = tables.ens(spark, sf, end=_SPLIT).groupBy(*KEYS).agg(F.avg("pred").alias("pred"))
    paired = calib.join(tables.monthly_truth(spark, sf), KEYS)
    model = linear.fit_cell_linear(paired, CELL, "pred", "truth")
    members = tables.ens(spark, sf, start=_SPLIT)
    return linear.predict_linear(members, model, CELL, "pred", "predicted").drop("pred")


@query("fit_predict_ensemble_forest")
def fit_predict_ensemble_forest(spark, sf):
    calib = tables.ens(spark, sf, end=_SPLIT).groupBy(*KEYS).agg(F.avg("pred").alias("pred"))
    paired = features.doy_encode(calib.join(tables.monthly_truth(spark, sf), KEYS))
    x = ["pred", "doy_sin", "doy_cos"]
    models = learning.fit_cells(paired, CELL, x, "truth", "RandomForestRegressor")
    members = features.doy_encode(tables.ens(spark, sf, start=_SPLIT))
    return trees.predict(members, models, CELL, x).select(*KEYS, "member", "predicted")


@query(
    "model_store",
    f"""with {PAIR}, {_LINES} select y, x, {r('b')} as slope, {r('a')} as intercept from lines""",
)
def model_store(spark, sf):
    model = linear.fit_cell_linear(tables.pair(spark, sf, end=_SPLIT), CELL, "pred", "truth")
    path = fresh_path(spark, "models")
    learning.save_models(model, path, "demo")
    return learning.load_models(spark, path, "demo")


@query(
    "predict_from_store",
    f"""with {PAIR}, {_LINES} select {d('time')} as time, y, x, {r('a + b * pred')} as predicted
      from pair join lines using (y, x) where time >= {_DAY}""",
)
def predict_from_store(spark, sf):
    model = linear.fit_cell_linear(tables.pair(spark, sf, end=_SPLIT), CELL, "pred", "truth")
    path = fresh_path(spark, "models")
    learning.save_models(model, path, "demo")
    stored = learning.load_models(spark, path, "demo")
    later = tables.pair(spark, sf, start=_SPLIT).select(*KEYS, "pred")
    return linear.predict_linear(later, stored, CELL, "pred", "predicted").drop("pred")


@query(
    "cell_store_predict",
    f"""with {PAIR}, {_LINES} select {d('time')} as time, y, x, {r('a + b * pred')} as predicted
      from pair left join lines using (y, x) where time >= {_DAY}""",
)
def cell_store_predict(spark, sf):
    """Lines are fitted and applied on a store bucketed by cell: neither step moves the cube."""
    cube = stored(tables.pair(spark, sf))
    store = cellstore.write_store(cube, fresh_path(spark, "store"), cellstore.bucket_count(cube))
    return cellstore.store_fit_predict(store, "pred", "truth", _SPLIT).select(*KEYS, "predicted")


_GX = [*X, "y", "x"]


def _global(spark, sf, learner, **settings):
    model = learning.fit_global(_train(spark, sf), KEYS, _GX, "truth", learner, **settings)
    return forests.predict(_test(spark, sf), model).select(*KEYS, "truth", "predicted")


@query("global_rf")
def global_rf(spark, sf):
    return _global(spark, sf, "RandomForestRegressor")


@query("global_gbt")
def global_gbt(spark, sf):
    return _global(spark, sf, "XGBRegressor")


@query("global_gbt_leafwise")
def global_gbt_leafwise(spark, sf):
    """Leaf-wise boosting that stops ten rounds after its best score on the last year of the training period."""
    train = _train(spark, sf)
    last = F.col("time") >= F.lit("1998-01-01").cast("date")
    model = learning.fit_global(
        train.where(~last), KEYS, _GX, "truth", "LGBMRegressor", valid=train.where(last), patience=10, subsample=0.8, columns=0.8
    )
    return forests.predict(_test(spark, sf), model).select(*KEYS, "truth", "predicted")


_EDGES = [5.0 * k for k in range(1, 10)]


@query(
    "tree_stump",
    f"""with {PAIR}, tr as (select pred, refe, truth from pair where time < {_DAY} and truth is not null),
      v as (select 0 as f, pred as v, truth from tr union all select 1, refe, truth from tr),
      g as (select f, edge, count(*) filter (v <= edge) as n1, sum(truth) filter (v <= edge) as s1, count(*) as n, sum(truth) as s
        from v, (select unnest({_EDGES}) as edge) group by f, edge),
      b as (select *, s1 * s1 / n1 + (s - s1) * (s - s1) / (n - n1) as gain from g where n1 > 0 and n1 < n order by gain desc, f, edge limit 1)
      select {d('time')} as time, y, x, {r('truth')} as truth,
        {r('case when (case f when 0 then pred else refe end) <= edge then s1 / n1 else (s - s1) / (n - n1) end')} as predicted
      from pair, b where time >= {_DAY}""",
)
def tree_stump(spark, sf):
    """One cut by distributed histograms over given edges."""
    two, edges = ["pred", "refe"], np.array(_EDGES)
    one = {"rounds": 1, "rate": 1.0, "limits": trees.Growth(depth=1), "cuts": [edges, edges], "finish": 0}
    model = forests.fit_boosted(tables.pair(spark, sf, end=_SPLIT), KEYS, two, "truth", **one)
    return forests.predict(tables.pair(spark, sf, start=_SPLIT), model).select(*KEYS, "truth", "predicted")


@query("global_adaboost")
def global_adaboost(spark, sf):
    out = learning.global_adaboost(_train(spark, sf), _test(spark, sf), _GX, "truth")
    return out.select(*KEYS, "truth", "predicted")


@query(
    "glm_tweedie",
    f"""with {PAIR}, m as (select avg(pred) as mp, avg(refe) as mr, avg(truth) as mt, covar_pop(pred, pred) as pp,
        covar_pop(pred, refe) as pr, covar_pop(refe, refe) as rr, covar_pop(pred, truth) as pt, covar_pop(refe, truth) as rt
        from pair where time < {_DAY} and truth is not null),
      c as (select *, (rr * pt - pr * rt) / (pp * rr - pr * pr) as bp, (pp * rt - pr * pt) / (pp * rr - pr * pr) as br from m)
      select {d('time')} as time, y, x, {r('truth')} as truth, {r('mt + bp * (pred - mp) + br * (refe - mr)')} as predicted
      from pair, c where time >= {_DAY}""",
)
def glm_tweedie(spark, sf):
    two = ["pred", "refe"]
    model = learning.fit_glm(stored(tables.pair(spark, sf, end=_SPLIT)), two, "truth", power=0)
    later = tables.pair(spark, sf, start=_SPLIT)
    return learning.predict_global(later, model, two).select(*KEYS, "truth", "predicted")


def _rain_cube(spark, sf, **period):
    return features.doy_encode(tables.rain(spark, sf, **period))


@query("glm_tweedie_gamma")
def glm_tweedie_gamma(spark, sf):
    model = learning.fit_glm(stored(_rain_cube(spark, sf, end=_SPLIT)), X, "truth", power=2)
    later = _rain_cube(spark, sf, start=_SPLIT)
    return learning.predict_global(later, model, X).select(*KEYS, "truth", "predicted")


@query("glm_tweedie_cells")
def glm_tweedie_cells(spark, sf):
    x = ["pred", "doy_sin", "doy_cos"]
    model = linear.fit_glm_cells(stored(_rain_cube(spark, sf, end=_SPLIT)), CELL, x, "truth", power=2)
    later = _rain_cube(spark, sf, start=_SPLIT)
    return linear.predict_glm(later, model, CELL, x, 2, "predicted").select(*KEYS, "truth", "predicted")


_SINGLE = f"""one as (select regr_slope(truth, pred) as b, regr_intercept(truth, pred) as a
  from pair where time < {_DAY} and truth is not null)"""


@query(
    "single_vs_multi",
    f"""with {PAIR}, {_LINES}, {_SINGLE},
      p as (select y, x, truth as t, one.a + one.b * pred as s, lines.a + lines.b * pred as m
        from pair join lines using (y, x) cross join one where time >= {_DAY} and truth is not null),
      c as (select y, x, {r2_sql('t', 's')} as r2s, avg(abs(t - s)) as maes, {r2_sql('t', 'm')} as r2m, avg(abs(t - m)) as maem
        from p group by 1, 2)
      select {r('avg(r2s)')} as r2_single, {r('avg(maes)')} as mae_single, {r('avg(r2m)')} as r2_multi,
        {r('avg(maem)')} as mae_multi from c""",
)
def single_vs_multi(spark, sf):
    calib = stored(tables.pair(spark, sf, end=_SPLIT))
    later = stored(tables.pair(spark, sf, start=_SPLIT).select(*KEYS, "truth", "pred"))
    one = linear.fit_cell_linear(calib, [], "pred", "truth")
    many = linear.fit_cell_linear(calib, CELL, "pred", "truth")
    single = linear.scores(linear.predict_linear(later, one, [], "pred", "predicted"), CELL)
    multi = linear.scores(linear.predict_linear(later, many, CELL, "pred", "predicted"), CELL)
    return learning.single_vs_multi(single, multi, CELL)


@query(
    "cv_rmse_cells",
    f"""with {PAIR}, ax as (select time, row_number() over (order by time) as pos, count(*) over () as n
        from (select distinct time from pair)),
      f as (select *, unnest(generate_series(1, 10)) as fold, n // 11 as size from ax),
      g as (select time, fold, pos <= n - (10 - fold + 1) * size as train from f where pos <= n - (10 - fold) * size),
      j as (select y, x, fold, train, truth, pred from pair join g using (time) where truth is not null),
      l as (select y, x, fold, regr_slope(truth, pred) as b, regr_intercept(truth, pred) as a from j where train group by 1, 2, 3),
      e as (select y, x, fold, sqrt(avg((a + b * pred - truth) * (a + b * pred - truth))) as rmse
        from j join l using (y, x, fold) where not train group by 1, 2, 3)
      select y, x, {r('avg(rmse)')} as rmse, count(rmse) as folds from e group by y, x""",
)
def cv_rmse_cells(spark, sf):
    cube = stored(tables.pair(spark, sf).select(*KEYS, "truth", "pred"))
    rows = learning.explode_folds(cube, splitting.split_timeseries(cube, 10))
    keys = [*CELL, "fold"]
    model = linear.fit_cell_linear(rows.filter("part = 'train'"), keys, "pred", "truth")
    scored = linear.predict_linear(rows.filter("part = 'test'"), model, keys, "pred", "predicted")
    return learning.fold_rmse(scored, CELL)


@query("cv_rmse_cells_boosted")
def cv_rmse_cells_boosted(spark, sf):
    """Ten folds of the tuned learner with the settings the tuner starts from."""
    return learning.cross_validate_cells(stored(_cube(spark, sf)), CELL, X, "truth", "LGBMRegressor")


@query("tune")
def tune(spark, sf):
    """Fifty trials over ten by ten sampled cells (all cells where the grid is smaller)."""
    sampled = splitting.split_tail(splitting.sample_cells(stored(_cube(spark, sf)), 10))
    return learning.tune(sampled, CELL, X, "truth")


@query("tree_model_store")
def tree_model_store(spark, sf):
    """Fitted trees are stored under a run key, loaded and applied."""
    models = learning.fit_cells(_train(spark, sf), CELL, X, "truth", "LGBMRegressor")
    path = fresh_path(spark, "models")
    learning.save_models(models, path, "trees")
    loaded = learning.load_models(spark, path, "trees")
    return trees.predict(_test(spark, sf), loaded, CELL, X).select(*KEYS, "predicted")


_TRIALS = PAIR + """,
trials as (select cast((year(time) - 1995) * 12 + month(time) as int) as number,
    sqrt(avg((pred - truth) * (pred - truth))) as value, avg(refe) as params_a, max(pred) as params_b
  from pair group by 1)"""


def _trials(spark, sf):
    cube = tables.pair(spark, sf)
    number = ((F.year("time") - 1995) * 12 + F.month("time")).cast("int")
    return cube.groupBy(number.alias("number")).agg(
        V.N.rmse("truth", "pred").alias("value"),
        F.avg("refe").alias("params_a"),
        F.max("pred").alias("params_b"),
    )


_TRIAL_COLS = f"number, {r('value')} as value, {r('params_a')} as params_a, {r('params_b')} as params_b"


@query("best_trial", f"with {_TRIALS} select {_TRIAL_COLS} from trials order by trials.value, number limit 1")
def best_trial(spark, sf):
    return learning.best_trial(_trials(spark, sf))


@query(
    "trial_history",
    f"""with {_TRIALS}, h as (select *, min(value) over (order by number) as best from trials)
      select {_TRIAL_COLS}, {r('best')} as best from h""",
)
def trial_history(spark, sf):
    return learning.trial_history(_trials(spark, sf))


@query(
    "trial_importance",
    f"""with {_TRIALS} select 'params_a' as param, {r('corr(params_a, value)')} as r from trials
      union all select 'params_b', {r('corr(params_b, value)')} from trials""",
)
def trial_importance(spark, sf):
    return learning.trial_importance(_trials(spark, sf), ["params_a", "params_b"])


_ROW = "turn || '|' || time || '|' || y || '|' || x"


@query(
    "permutation_importance",
    f"""with {PAIR}, {_LINES}, v as (select time, y, x, truth, pred, refe from pair
        where time >= {_DAY} and truth is not null and pred is not null and refe is not null),
      t as (select v.*, turn from v, unnest([1, 2, 3]) as turns(turn)),
      k as (select *, row_number() over (partition by turn order by md5('42to|' || {_ROW}), time, y, x) as i,
        row_number() over (partition by turn order by md5('42from|' || {_ROW}), time, y, x) as j from t),
      p as (select a + b * k.pred as p0, a + b * donor.pred as p1, k.truth from k join k donor on donor.turn = k.turn and donor.j = k.i
        join lines on lines.y = k.y and lines.x = k.x),
      s as (select sum(round((p0 - truth) * (p0 - truth) * 1048576)) / count(p0) / 1048576 as e0,
        sum(round((p1 - truth) * (p1 - truth) * 1048576)) / count(p0) / 1048576 as e1, count(p0) // 3 as n from p)
      select 'pred' as feature, {r('e1 - e0')} as importance, n from s union all select 'refe', 0.0, n from s""",
)
def permutation_importance(spark, sf):
    """The lines per cell use `pred` alone, so `refe` has no importance."""
    model = stored(linear.fit_cell_linear(tables.pair(spark, sf, end=_SPLIT), CELL, "pred", "truth"))
    later = tables.pair(spark, sf, start=_SPLIT)

    def predict(rows):
        return linear.predict_linear(rows, model, CELL, "pred", "predicted")

    return learning.permutation_importance(later, KEYS, ["pred", "refe"], "truth", predict, repeats=3)


@query("feature_importance")
def feature_importance(spark, sf):
    cube = stored(_cube(spark, sf))
    return forests.importances(cube, learning.fit_global(cube, KEYS, _GX, "truth", "RandomForestRegressor"))


def _run_sql(predictand: str, table: str, product: str, source: str) -> str:
    return f"""select '{product}' as run_key, '{predictand}' as predictand, avg(p - t) as bias,
      avg(abs(p - t)) as mae, sqrt(avg((p - t) * (p - t))) as rmse from (
      select avg(truth) as t, avg({product}) as p from {source} group by y, x, year(time))"""


@query(
    "rank_runs",
    f"""with {RAIN}, {BOOKED}, j as (select pair.*, model from pair join booked using (time, y, x)),
      k as (select rain.*, greatest(model - 25, 0) as model from rain join booked using (time, y, x)),
      s as ({" union all ".join(
          _run_sql(p, t, product, t) for p, t in (("tasmean", "j"), ("pr", "k")) for product in ("pred", "refe", "model")
      )})
      select run_key, predictand, {r('bias')} as bias, {r('mae')} as mae, {r('rmse')} as rmse,
        cast(rank() over (partition by predictand order by s.rmse) as int) as rank from s""",
)
def rank_runs(spark, sf):
    products = ["pred", "refe", "model"]
    booked = tables.booked(spark, sf)
    cube = stored(tables.pair(spark, sf))
    warm = V.model_vs_reference(cube.join(booked, KEYS), products)
    rain_booked = booked.withColumn("model", F.greatest(F.col("model") - 25, F.lit(0.0)))
    wet = V.model_vs_reference(tables.as_rain(cube).join(rain_booked, KEYS), products)
    runs = warm.withColumn("predictand", F.lit("tasmean")).unionByName(
        wet.withColumn("predictand", F.lit("pr"))
    )
    return learning.rank_runs(runs.withColumnRenamed("product", "run_key"))
