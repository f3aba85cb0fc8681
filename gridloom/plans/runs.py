"""Whole runs composed from the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators import ensemble, learning, regrid, resample, terrain, trees, verification
from gridloom.operators.features import doy_encode, mask_by_truth, valid_cells
from gridloom.schema import PREDICTANDS, check_vocabulary
from gridloom.sources import files
from gridloom.sources.workspace import stored

CELL = ["y", "x"]


def prepare_reanalysis(
    subdaily: DataFrame,
    target_y: DataFrame,
    target_x: DataFrame,
    value: str,
    how: str = "mean",
    regrid_first: bool = False,
    width: float = 1000.0,
) -> DataFrame:
    """Sub-daily source cube (ts, y, x, value) to a daily cube on the target grid.

    Daily mean and sum commute with the remap, so the smaller daily cube is
    remapped; extremes and first values do not, hence `regrid_first`.
    """
    daily = {
        "mean": resample.daily_mean,
        "sum": resample.daily_sum,
        "max": resample.daily_max,
        "min": resample.daily_min,
        "first": resample.daily_first,
    }[how]
    if regrid_first:
        fine = regrid.regrid_bilinear(subdaily, target_y, target_x, ["ts"], [value], width)
        return daily(fine, CELL, "ts", value)
    return regrid.regrid_bilinear(
        daily(subdaily, CELL, "ts", value), target_y, target_x, ["time"], [value], width
    )


def predictors(cube: DataFrame, static: DataFrame | None = None) -> DataFrame:
    """Add static columns and the day of year to a predictor cube."""
    return doy_encode(terrain.static_broadcast(cube, static) if static is not None else cube)


def downscale_forecast(
    reanalysis: DataFrame,
    observation: DataFrame,
    forecast: DataFrame,
    features: list[str],
    predictand: str,
    learner: str,
    path: str,
    run_key: str,
    static: DataFrame | None = None,
    calibration: Column | None = None,
    drop_invalid_cells: bool = True,
    overwrite: bool = False,
    **settings,
) -> DataFrame:
    """Fit one model per cell on the past, predict every member, store and return the cube.

    The models are fitted once and applied to all members. A finished run is
    read back instead of being computed again.
    """
    check_vocabulary([predictand], PREDICTANDS, "predictand")
    spark = forecast.sparkSession
    target = f"{path}/run_key={run_key}"
    if overwrite or not files.exists(spark, f"{target}/_SUCCESS"):
        encoded = [*features, "doy_sin", "doy_cos"]
        past = predictors(reanalysis, static).join(
            observation.select("time", *CELL, predictand), ["time", *CELL]
        )
        if calibration is not None:
            past = past.filter(calibration)
        if drop_invalid_cells:
            past = valid_cells(past, CELL, [*features, predictand])
        models = learning.fit_cells(past, CELL, encoded, predictand, learner, **settings)
        members = predictors(forecast, static)
        out = trees.predict(members, models, CELL, encoded, predictand)
        keys = [c for c in ("time", "y", "x", "member") if c in out.columns]
        files.write_cube(out.select(*keys, predictand), path, run_key, overwrite=overwrite)
    return spark.read.parquet(target)


def verify_run(truth: DataFrame, pred: DataFrame, relative: bool = False) -> DataFrame:
    """Deterministic scores of a run as one long table (score, value).

    Both frames have time, y, x and `truth` or `pred`. The paired cube is
    written once; every score is an aggregation over it.
    """
    pair = truth.select("time", *CELL, "truth").join(pred.select("time", *CELL, "pred"), ["time", *CELL])
    pair = stored(mask_by_truth(pair, "truth", ["pred"]), "pair")

    def named(df: DataFrame, prefix: str = "") -> DataFrame:
        renamed = df.select(*[F.col(c).cast("double").alias(f"{prefix}{c}") for c in df.columns])
        return renamed.unpivot([], renamed.columns, "score", "value")

    parts = [
        named(verification.r2_pooled_monthly(pair), "monthly_"),
        named(verification.r2_pooled_anomaly(pair), "anomaly_"),
        named(verification.skill_yearly(pair, relative), "yearly_"),
        named(verification.extreme_skill(pair, 0.98, relative), "p98_"),
        named(verification.pearson_total(pair)),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def verify_ensemble(ens: DataFrame, obs: DataFrame) -> dict[str, DataFrame]:
    """Probabilistic scores of an ensemble, keyed by score."""
    scores = stored(ensemble.crps(ens, obs), "crps")
    return {
        "crps_map": ensemble.crps_mean(scores, CELL),
        "crps_series": ensemble.crps_mean(scores, ["time"]),
        "crps_season": ensemble.crps_season(scores),
        "spread_error": ensemble.spread_error_cell(ens, obs),
        "rps": ensemble.rps_terciles(ens, obs),
        "ranks": ensemble.rank_histogram(ens, obs),
    }
