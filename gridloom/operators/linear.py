"""Linear models per cell from aggregated moments.

Each cell contributes one row of means and covariances (partial sums, no cell
is gathered); the small systems are then solved in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.numeric import mae, r2, rmse
from gridloom.operators.ranks import attach
from gridloom.sources.workspace import cut


def fit_cell_linear(df: DataFrame, keys: list[str], feature: str, target: str) -> DataFrame:
    """Least-squares line per group: slope and intercept."""
    return df.groupBy(*keys).agg(
        F.regr_slope(target, feature).alias("slope"),
        F.regr_intercept(target, feature).alias("intercept"),
    )


def predict_linear(df: DataFrame, model: DataFrame, keys: list[str], feature: str, out: str) -> DataFrame:
    """Apply per-group lines; rows without a model stay NULL."""
    line = F.col("intercept") + F.col("slope") * F.col(feature)
    return attach(df, model.select(*keys, "slope", "intercept"), keys).withColumn(out, line).drop(
        "slope", "intercept"
    )


def _solve(cov: Column, mean: Column, penalty: Column) -> Column:
    """Coefficients and intercept from a covariance of (features, target) and their means.

    The function is built here, not at import, so that it travels to the
    executors by value and needs no session beforehand.
    """

    def solve(covs: pd.Series, means: pd.Series, penalties: pd.Series) -> pd.Series:
        out = []
        for c, m, lam in zip(covs, means, penalties):
            m = np.asarray(m, dtype=float)
            c = np.asarray(c, dtype=float).reshape(len(m), len(m))
            if not np.isfinite(c).all():
                out.append(None)
                continue
            a = c[:-1, :-1] + lam * np.eye(len(m) - 1)
            beta = np.linalg.lstsq(a, c[:-1, -1], rcond=None)[0]
            out.append([*beta, m[-1] - float(beta @ m[:-1])])
        return pd.Series(out)

    return F.pandas_udf(solve, T.ArrayType(T.DoubleType()))(cov, mean, penalty)


def _moments(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    pairs = {(i, j) for i in range(len(columns)) for j in range(i + 1)}
    row = df.groupBy(*keys).agg(
        *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(columns)],
        *[F.covar_pop(columns[i], columns[j]).alias(f"_c{i}_{j}") for i, j in sorted(pairs)],
    )
    n = range(len(columns))
    cov = F.array(*[F.col(f"_c{max(i, j)}_{min(i, j)}") for i in n for j in n])
    return row.select(*keys, cov.alias("_cov"), F.array(*[F.col(f"_m{i}") for i in n]).alias("_mean"))


def fit_ridge(
    df: DataFrame, keys: list[str], features: list[str], target: str, penalty: float = 0.0
) -> DataFrame:
    """Ridge regression per group: (keys, coef), coef ending with the intercept."""
    whole = df.dropna(subset=[*features, target])
    moments = _moments(whole, keys, [*features, target])
    return moments.select(*keys, _solve(F.col("_cov"), F.col("_mean"), F.lit(float(penalty))).alias("coef"))


def linear_term(features: list[str], coef: str = "coef") -> Column:
    term = F.element_at(coef, -1)
    for i, f in enumerate(features):
        term = term + F.element_at(coef, i + 1) * F.col(f)
    return term


def predict_ridge(df: DataFrame, model: DataFrame, keys: list[str], features: list[str], out: str) -> DataFrame:
    return attach(df, model, keys).withColumn(out, linear_term(features)).drop("coef")


def fit_glm_cells(
    df: DataFrame,
    keys: list[str],
    features: list[str],
    target: str,
    power: float = 0.0,
    penalty: float = 1.0,
    tolerance: float = 1e-6,
    most_rounds: int = 100,
) -> DataFrame:
    """Generalised linear model per group by reweighted least squares.

    Power 0 (normal, identity link) is one least-squares fit. Power 2 (gamma,
    log link) repeats least squares on the working response; its working
    weights are constant, so each round is one aggregation over all groups. It
    ends when no coefficient of any group moves by more than `tolerance`, and
    raises when that isn't reached. `penalty` is the L2 penalty beside the mean
    deviance. Rows without a positive target can't enter a gamma model and are
    left out.
    """
    if power == 0:
        return fit_ridge(df, keys, features, target, penalty)
    if power != 2:
        raise ValueError("power must be 0 (normal) or 2 (gamma)")
    rows = df.dropna(subset=[*features, target]).filter(F.col(target) > 0)
    rows = rows.select(*keys, *features, target)
    model = fit_ridge(rows.withColumn("_z", F.log(target)), keys, features, "_z", penalty)
    for _ in range(most_rounds):
        model = cut(model)
        eta = linear_term(features)
        working = attach(rows, model, keys).withColumn(
            "_z", eta + F.col(target) * F.exp(-eta) - F.lit(1.0)
        )
        after = cut(fit_ridge(working.drop("coef"), keys, features, "_z", penalty))
        moves = F.aggregate(
            F.zip_with("coef", "_was", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, b: F.greatest(a, b)
        )
        moved = attach(after, model.select(*keys, F.col("coef").alias("_was")), keys).agg(F.max(moves)).first()[0]
        model = after
        if moved is None or moved <= tolerance:
            return model
    raise RuntimeError("the gamma model did not converge")


def predict_glm(df: DataFrame, model: DataFrame, keys: list[str], features: list[str], power: float, out: str) -> DataFrame:
    linear = predict_ridge(df, model, keys, features, out)
    return linear if power == 0 else linear.withColumn(out, F.exp(out))


def scores(df: DataFrame, keys: list[str], truth: str = "truth", pred: str = "predicted") -> DataFrame:
    """R2, MAE and RMSE per group."""
    return df.groupBy(*keys).agg(
        r2(truth, pred).alias("r2"), mae(truth, pred).alias("mae"), rmse(truth, pred).alias("rmse")
    )
