"""Deterministic scores of a prediction against the truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import numeric as N
from gridloom.functions.calendar import season
from gridloom.operators.aggregate import season_mean, season_quantile, year_mean, year_quantile
from gridloom.operators.features import anomaly, mask_by_truth
from gridloom.operators.ranks import attach

CELL = ["y", "x"]
TP = ["truth", "pred"]


def monthly_means(pair: DataFrame, keys: list[str] = CELL) -> DataFrame:
    """Month means of truth and prediction, the prediction only where the truth is known."""
    masked = mask_by_truth(pair, "truth", ["pred"])
    return masked.groupBy(*keys, F.trunc("time", "month").alias("month")).agg(
        F.avg("truth").alias("truth"), F.avg("pred").alias("pred")
    )


def daily_anomalies(pair: DataFrame, keys: list[str] = CELL) -> DataFrame:
    """Departures of truth and masked prediction from their month-of-year means."""
    return anomaly(mask_by_truth(pair, "truth", ["pred"]), keys, TP, "month")


def r2_pooled_monthly(pair: DataFrame) -> DataFrame:
    return monthly_means(pair).agg(N.r2("truth", "pred").alias("r2"))


def r2_pooled_anomaly(pair: DataFrame) -> DataFrame:
    return daily_anomalies(pair).agg(N.r2("truth", "pred").alias("r2"))


def r2_by(pair: DataFrame, keys: list[str], cell: list[str] = CELL) -> DataFrame:
    """R2 of month means and of daily anomalies per group `keys` (a cell, a member)."""
    series = list(dict.fromkeys([*cell, *keys]))
    monthly = monthly_means(pair, series).groupBy(*keys).agg(N.r2("truth", "pred").alias("r2_monthly"))
    daily = daily_anomalies(pair, series).groupBy(*keys).agg(N.r2("truth", "pred").alias("r2_anomaly"))
    return monthly.join(daily, keys)


def _scores(relative: bool = False, truth: str = "truth", pred: str = "pred") -> list:
    error = N.relative_bias(pred, truth) if relative else F.col(pred) - F.col(truth)
    return [
        F.avg(error).alias("bias"),
        N.mae(truth, pred).alias("mae"),
        N.rmse(truth, pred).alias("rmse"),
    ]


def skill_yearly(pair: DataFrame, relative: bool = False) -> DataFrame:
    """Bias (absolute or in percent), MAE and RMSE of the cells' year means."""
    return year_mean(pair, TP).agg(*_scores(relative))


def pearson_by_year(pair: DataFrame) -> DataFrame:
    """Correlation over the grid of each year's means."""
    return year_mean(pair, TP).groupBy("year").agg(F.corr("pred", "truth").alias("r"))


def pearson_total(pair: DataFrame) -> DataFrame:
    """Pooled correlation of year means, and the mean of the yearly ones.

    Both come out of one aggregation per year: the pooled value is rebuilt
    from the yearly counts, means and co-moments.
    """
    both = N.both("truth", "pred")
    t, p = F.when(both, F.col("truth")), F.when(both, F.col("pred"))
    years = year_mean(pair, TP).groupBy("year").agg(
        F.corr("pred", "truth").alias("r"),
        F.count(t).alias("n"),
        F.avg(t).alias("mt"),
        F.avg(p).alias("mp"),
        F.var_pop(t).alias("vt"),
        F.var_pop(p).alias("vp"),
        F.covar_pop(t, p).alias("c"),
    )
    n = F.col("n")
    centre = years.agg(
        F.try_divide(F.sum(n * F.col("mt")), F.sum(n)).alias("gt"),
        F.try_divide(F.sum(n * F.col("mp")), F.sum(n)).alias("gp"),
    )
    dt, dp = F.col("mt") - F.col("gt"), F.col("mp") - F.col("gp")
    cov = F.sum(n * (F.col("c") + dt * dp))
    vt, vp = F.sum(n * (F.col("vt") + dt * dt)), F.sum(n * (F.col("vp") + dp * dp))
    return attach(years, centre, []).agg(
        F.try_divide(cov, F.sqrt(vt) * F.sqrt(vp)).alias("r_pooled"), F.avg("r").alias("r_mean")
    )


def bias_map(pair: DataFrame) -> DataFrame:
    """Mean difference of year means per cell."""
    return (
        year_mean(pair, TP)
        .groupBy(*CELL)
        .agg(F.avg("truth").alias("truth"), F.avg("pred").alias("pred"))
        .withColumn("bias", F.col("pred") - F.col("truth"))
    )


def _over_cells(df: DataFrame, keys: list[str], relative: bool) -> DataFrame:
    error = N.relative_bias("pred", "truth") if relative else F.col("pred") - F.col("truth")
    scored = df.withColumn("_e", error)
    return scored.groupBy(*keys).agg(
        F.avg("_e").alias("bias"), F.min("_e").alias("bias_min"), F.max("_e").alias("bias_max")
    )


def bias_season(pair: DataFrame, relative: bool = False) -> DataFrame:
    """Seasonal bias: mean, smallest and largest over the cells."""
    return _over_cells(season_mean(pair, TP), ["season"], relative)


def extreme_skill(pair: DataFrame, q: float = 0.98, relative: bool = False) -> DataFrame:
    """Bias, MAE and RMSE of the cells' yearly extreme quantile."""
    return year_quantile(pair, TP, q).agg(*_scores(relative))


def extreme_bias_season(pair: DataFrame, q: float = 0.98) -> DataFrame:
    """Relative bias of the seasonal extreme quantile over the cells."""
    return _over_cells(season_quantile(pair, TP, q), ["season"], relative=True)


def _wet_counts(pair: DataFrame, threshold: float) -> DataFrame:
    """Per cell and season, and per cell over the year: valid, wet and expected steps."""
    ok = N.both("truth", "pred")
    sums = pair.groupBy(*CELL, season("time").alias("season")).agg(
        F.count_if(ok).alias("valid"),
        *[F.count_if(ok & (F.col(v) >= threshold)).alias(f"wet_{v}") for v in TP],
        *[
            F.coalesce(F.sum(F.when(ok & (F.col(v) >= threshold), F.col(v))), F.lit(0.0)).alias(f"amount_{v}")
            for v in TP
        ],
    )
    steps = (
        pair.select("time").distinct().groupBy(season("time").alias("season")).agg(F.count(F.lit(1)).alias("steps"))
    )

    def both_periods(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
        period = F.explode(F.array(F.lit("annual"), F.col("season")))
        return df.withColumn("period", period).groupBy(*keys, "period").agg(
            *[F.sum(v).alias(v) for v in values]
        )

    names = ["valid", "wet_truth", "wet_pred", "amount_truth", "amount_pred"]
    return both_periods(sums, CELL, names).join(both_periods(steps, [], ["steps"]), ["period"])


def wet_day_freq(pair: DataFrame, threshold: float = 1.0, skipna: bool = False) -> DataFrame:
    """Share of wet days in percent, annual and by season, and its relative bias.

    Without `skipna` a cell with any missing step has no frequency.
    """
    counts = _wet_counts(pair, threshold)
    out = counts
    for v in TP:
        share = F.lit(100.0) * N.ratio(f"wet_{v}", "valid")
        out = out.withColumn(
            v, share if skipna else F.when(F.col("valid") == F.col("steps"), share)
        )
    return out.select(*CELL, "period", *TP, N.relative_bias("pred", "truth").alias("bias"))


def wet_day_intensity(pair: DataFrame, threshold: float = 1.0, skipna: bool = False) -> DataFrame:
    """Mean amount on wet days over the whole period and its relative bias."""
    out = _wet_counts(pair, threshold).filter(F.col("period") == "annual")
    for v in TP:
        mean = N.ratio(f"amount_{v}", f"wet_{v}")
        out = out.withColumn(v, mean if skipna else F.when(F.col("valid") == F.col("steps"), mean))
    return out.select(*CELL, *TP, N.relative_bias("pred", "truth").alias("bias"))


def model_vs_reference(triple: DataFrame, products: list[str]) -> DataFrame:
    """The same yearly skill for several products against one truth, in one pass."""
    years = year_mean(triple, ["truth", *products])
    long = years.unpivot(["year", *CELL, "truth"], products, "product", "pred")
    return long.groupBy("product").agg(*_scores())


def compare_series(cube: DataFrame, products: list[str], by: str = "month") -> DataFrame:
    """Area-mean cycle of several products beside each other, by month or year."""
    bucket = {"month": F.month("time"), "year": F.year("time")}[by]
    area = cube.groupBy("time").agg(*[F.avg(v).alias(v) for v in products])
    return area.groupBy(bucket.alias(by)).agg(*[F.avg(v).alias(v) for v in products])
