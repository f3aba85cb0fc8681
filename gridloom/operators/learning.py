"""Learning: per-cell models by name, global models, tuning and run comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridloom.functions.numeric import rmse
from gridloom.operators import forests, trees
from gridloom.operators.ranks import hash_order, positions
from gridloom.operators.splitting import _axis_positions, uniform
from gridloom.schema import CELL, LEARNERS, check_vocabulary
from gridloom.sources.workspace import cut, stored


#: What a learner name stands for: the routine and the settings its package starts from.
SETTINGS = {
    "RandomForestRegressor": (trees.forest, {"trees": 100, "limits": trees.Growth()}),
    "AdaBoostRegressor": (trees.adaboost, {"rounds": 50, "limits": trees.Growth(depth=3)}),
    "XGBRegressor": (trees.boosted, {"rounds": 100, "rate": 0.3, "limits": trees.Growth(depth=6, l2=1.0)}),
    "LGBMRegressor": (trees.boosted, {"rounds": 100, "rate": 0.1, "limits": trees.Growth(leaves=31, min_rows=20.0)}),
}


def fit_cells(
    df: DataFrame, keys: list[str], features: list[str], target: str, learner: str, order: str = "time", **settings
) -> DataFrame:
    """One model per cell for a learner known by name; the result is a model table."""
    check_vocabulary([learner], LEARNERS, "learner")
    routine, usual = SETTINGS[learner]
    return stored(trees.fit(df, keys, features, target, order, routine, **(usual | settings)), "models")


def cross_validate_cells(
    df: DataFrame, keys: list[str], features: list[str], target: str, learner: str, folds: int = 10, **settings
) -> DataFrame:
    """Mean RMSE per cell over expanding-window folds of the cube's time axis."""
    check_vocabulary([learner], LEARNERS, "learner")
    routine, usual = SETTINGS[learner]
    axis = stored(_axis_positions(df), "axis")
    return trees.cross_validated(
        trees.with_axis_position(df, axis), keys, features, target, folds, routine, **(usual | settings)
    )


def save_models(models: DataFrame, path: str, run_key: str) -> None:
    """Store a model table under a run key."""
    models.write.mode("overwrite").parquet(f"{path}/run_key={run_key}")


def load_models(spark: SparkSession, path: str, run_key: str) -> DataFrame:
    return spark.read.parquet(f"{path}/run_key={run_key}")


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    """Feature vector column; rows with a missing feature are left out."""
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(
        df.dropna(subset=features)
    )


def split_candidates(rows: DataFrame, features: list[str]) -> int:
    """Bins per predictor: as fine as the per-cell learners, and one for each coordinate of the grid."""
    axes = [F.count_distinct(c) for c in CELL if c in features]
    return max(trees.BINS, *rows.agg(*axes).first()) if axes else trees.BINS


#: What a learner name stands for on the whole grid.
GLOBAL = {
    "RandomForestRegressor": (forests.fit_forest, {"trees": 100, "limits": trees.Growth()}),
    "XGBRegressor": (forests.fit_boosted, {"rounds": 100, "rate": 0.3, "limits": trees.Growth(depth=6, l2=1.0)}),
    "LGBMRegressor": (forests.fit_boosted, {"rounds": 100, "rate": 0.1, "limits": trees.Growth(leaves=31, min_rows=20.0)}),
}


def fit_global(df: DataFrame, keys: list[str], features: list[str], target: str, learner: str, **settings) -> forests.Model | None:
    """One model for the whole grid; cell coordinates may be among the features and have a bin each."""
    check_vocabulary([learner], GLOBAL, "global learner")
    routine, usual = GLOBAL[learner]
    return routine(df, keys, features, target, **(usual | {"exact": [c for c in CELL if c in features]} | settings))


def predict_global(df: DataFrame, model: Transformer, features: list[str]) -> DataFrame:
    """Adds `predicted`; rows with a missing predictor stay, with NULL."""
    whole = F.lit(True)
    for f in features:
        whole = whole & F.col(f).isNotNull()
    known = model.transform(assemble(df.filter(whole), features)).drop("features")
    unknown = df.filter(~whole).withColumn("predicted", F.lit(None).cast("double"))
    return known.select(*df.columns, "predicted").unionByName(unknown)


def fit_glm(df: DataFrame, features: list[str], target: str, power: float):
    """Tweedie model of the whole grid: power 0 for temperature, 2 for precipitation."""
    rows = df.dropna(subset=[target])
    if power > 0:
        rows = rows.filter(F.col(target) > 0)
    glm = GeneralizedLinearRegression(
        family="tweedie",
        variancePower=power,
        linkPower=1.0 if power == 0 else 0.0,
        featuresCol="features",
        labelCol=target,
        predictionCol="predicted",
        maxIter=25,
    )
    return glm.fit(assemble(rows, features))


def global_adaboost(
    train: DataFrame, test: DataFrame, features: list[str], target: str, rounds: int = 50, depth: int = 3
) -> DataFrame:
    """AdaBoost.R2 over weighted decision trees, one model for the whole grid.

    Weighted median over trees is taken per row from as many columns as there
    are rounds; the training weights are checkpointed each round.
    """
    rows = cut(assemble(train.dropna(subset=[target]), features).withColumn("_w", F.lit(1.0)))
    whole = F.lit(True)
    for f in features:
        whole = whole & F.col(f).isNotNull()
    out = assemble(test.filter(whole), features)
    cast: list[Column] = []
    bins = split_candidates(rows, features)
    for i in range(rounds):
        tree = DecisionTreeRegressor(
            featuresCol="features",
            labelCol=target,
            weightCol="_w",
            maxDepth=depth,
            maxBins=bins,
            predictionCol=f"_p{i}",
            seed=42,
        ).fit(rows)
        scored = tree.transform(rows).withColumn("_e", F.abs(F.col(target) - F.col(f"_p{i}")))
        loss = scored.agg(
            F.max("_e").alias("worst"),
            F.try_divide(F.sum(F.col("_w") * F.col("_e")), F.sum("_w")).alias("mean"),
            F.avg("_w").alias("scale"),
        ).first()
        if not loss.worst:
            out = tree.transform(out)
            cast = [F.struct(F.col(f"_p{i}").alias("value"), F.lit(1.0).alias("weight"))]
            break
        average = loss["mean"] / loss.worst
        if average >= 0.5 and cast:
            break
        beta = max(average / (1 - average), 1e-12) if average < 0.5 else 0.5
        out = tree.transform(out)
        vote = F.lit(-1.0) * F.log(F.lit(beta))
        cast.append(F.struct(F.col(f"_p{i}").alias("value"), vote.alias("weight")))
        weight = F.col("_w") / F.lit(loss.scale) * F.pow(F.lit(beta), 1 - F.col("_e") / F.lit(loss.worst))
        rows = cut(scored.withColumn("_w", weight).drop("_e", f"_p{i}"))
        if average >= 0.5:
            break
    ordered = F.array_sort(F.array(*cast))
    half = F.aggregate(ordered, F.lit(0.0), lambda a, e: a + e["weight"]) / 2
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("value"))
    median = F.aggregate(
        ordered,
        start,
        lambda a, e: F.struct(
            (a["sum"] + e["weight"]).alias("sum"),
            F.when(a["value"].isNotNull(), a["value"])
            .when(a["sum"] + e["weight"] >= half, e["value"])
            .alias("value"),
        ),
        lambda a: a["value"],
    )
    unknown = test.filter(~whole).withColumn("predicted", F.lit(None).cast("double"))
    return out.withColumn("predicted", median).select(*test.columns, "predicted").unionByName(unknown)


def explode_folds(df: DataFrame, folds: DataFrame) -> DataFrame:
    """Give every row its part in every fold (fold, time, part)."""
    return df.join(folds, ["time"])


def fold_rmse(predicted: DataFrame, keys: list[str], truth: str = "truth", pred: str = "predicted") -> DataFrame:
    """Mean over folds of each cell's RMSE on the fold's test part."""
    per_fold = predicted.groupBy(*keys, "fold").agg(rmse(truth, pred).alias("rmse"))
    return per_fold.groupBy(*keys).agg(F.avg("rmse").alias("rmse"), F.count("rmse").alias("folds"))


# Search space of the tuner (lists are chosen from, pairs are limits).
RATES = [0.006, 0.008, 0.01, 0.014, 0.017, 0.02]
SUBSAMPLES = [0.4, 0.5, 0.6, 0.7, 0.8, 1.0]
COLUMNS = [0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
DEPTHS = [10, 20, 100]
PENALTIES = (1e-3, 10.0)
LEAVES = (1, 1000)
LEAF_ROWS = (1, 300)
TRIALS, ROUNDS, PATIENCE = 50, 20_000, 100


def trial_settings(number: Column, seed: int = 42) -> dict[str, Column]:
    """Random settings of a trial, reproducible from its number."""

    def choice(name: str, values: list) -> Column:
        at = F.floor(uniform(f"{seed}{name}", number) * len(values)).cast("int")
        return F.get(F.array(*[F.lit(v) for v in values]), at)

    def logarithmic(name: str, low: float, high: float) -> Column:
        return F.lit(low) * F.pow(F.lit(high / low), uniform(f"{seed}{name}", number))

    def whole(name: str, low: int, high: int) -> Column:
        return F.floor(low + (high - low + 1) * uniform(f"{seed}{name}", number)).cast("int")

    return {
        "rate": choice("rate", RATES),
        "subsample": choice("subsample", SUBSAMPLES),
        "colsample": choice("colsample", COLUMNS),
        "depth": choice("depth", DEPTHS),
        "num_leaves": whole("num_leaves", *LEAVES),
        "min_rows": whole("min_rows", *LEAF_ROWS).cast("double"),
        "l1": logarithmic("l1", *PENALTIES),
        "l2": logarithmic("l2", *PENALTIES),
    }


def tune(
    df: DataFrame,
    cell: list[str],
    features: list[str],
    target: str,
    trials: int = TRIALS,
    rounds: int = ROUNDS,
    patience: int = PATIENCE,
    seed: int = 42,
) -> DataFrame:
    """Random search: mean RMSE over the cells for every trial of leaf-wise boosting.

    `df` has a column `part` (train or valid). Boosting stops `patience` rounds after its best score on
    the validation part. Cells without usable rows in both parts do not enter the mean.
    """
    log = df.sparkSession.range(1, trials + 1).select(F.col("id").cast("int").alias("number"))
    settings = trial_settings(F.col("number"), seed)
    log = log.withColumns(settings)
    drawn = [r.asDict() for r in log.orderBy("number").collect()]
    scored = trees.trial_scores(df, cell, features, target, drawn, rounds, patience, seed)
    return (
        scored.groupBy("number")
        .agg(F.avg("rmse").alias("value"), F.count("rmse").alias("cells"), F.avg("rounds").alias("rounds"))
        .join(log.withColumnsRenamed({n: f"params_{n}" for n in settings}), ["number"])
    )


def best_trial(trials: DataFrame, by: str = "value") -> DataFrame:
    """The row with the lowest objective; ties go to the earlier trial."""
    return trials.filter(F.col(by).isNotNull()).orderBy(by, "number").limit(1)


def trial_history(trials: DataFrame, by: str = "value") -> DataFrame:
    """Best objective so far, in trial order (the log has one row per trial)."""
    so_far = W.partitionBy().orderBy("number").rowsBetween(W.unboundedPreceding, W.currentRow)
    return trials.withColumn("best", F.min(by).over(so_far))


def trial_importance(trials: DataFrame, params: list[str], by: str = "value") -> DataFrame:
    """Correlation of each parameter with the objective."""
    row = trials.agg(*[F.corr(p, by).alias(p) for p in params])
    return row.unpivot([], params, "param", "r")


#: Squared errors are summed as whole multiples of its inverse, so that sums don't depend on partitions.
ERROR_UNITS = 1 << 20


def permutation_importance(
    df: DataFrame,
    keys: list[str],
    features: list[str],
    target: str,
    predict: Callable[[DataFrame], DataFrame],
    repeats: int = 5,
    seed: int = 42,
) -> DataFrame:
    """Rise of the mean squared error when a feature is permuted: (feature, importance, n).

    `predict` adds `predicted` to rows of (keys, features, target). A permutation joins the ranks of two
    seeded hash orders of the rows (`keys` name a row); all features take their values from the same donor
    row, one feature at a time, so one join a repeat serves all. Ranks are counted in chunks. Rows with a missing
    value are left out; an unused feature has exactly 0; predictions that are missing don't count.
    """
    rows = stored(df.dropna(subset=[*features, target]).select(*dict.fromkeys([*keys, *features, target])), "rows")
    turns = rows.withColumn("_turn", F.explode(F.sequence(F.lit(1), F.lit(repeats))))

    def ranked(order: str) -> DataFrame:
        hashed = turns.withColumn("_h", hash_order(f"{seed}{order}", "_turn", *keys))
        return positions(hashed, ["_turn"], ["_h", *keys], F.substring("_h", 1, 4), "_pos").drop("_h")

    donors = ranked("from").select("_turn", "_pos", F.struct(*features).alias("_donor"))
    met = ranked("to").join(donors, ["_turn", "_pos"])
    variants = [F.struct(F.lit(None).cast("string").alias("feature"), *features)] + [
        F.struct(F.lit(f).alias("feature"), *[(F.col("_donor")[g] if g == f else F.col(g)).alias(g) for g in features]) for f in features
    ]
    others = [c for c in rows.columns if c not in features]
    tried = met.select("_turn", *others, F.explode(F.array(*variants)).alias("_t")).select("_turn", *others, "_t.*")
    gap = F.col("predicted") - F.col(target)
    units = F.round(gap * gap * ERROR_UNITS).cast("decimal(30,0)")
    sums = predict(tried).groupBy("feature").agg(F.sum(units).alias("units"), F.count("predicted").alias("n"))
    mean = F.col("units").cast("double") / F.col("n") / ERROR_UNITS
    base = sums.filter("feature is null").select(mean.alias("base"))
    return sums.filter("feature is not null").select("feature", (mean - base.scalar()).alias("importance"), (F.col("n") / repeats).cast("long").alias("n"))


def rank_runs(scores: DataFrame, within: str = "predictand", by: str = "rmse") -> DataFrame:
    """Rank runs by score within each predictand (one row per run)."""
    return scores.withColumn("rank", F.rank().over(W.partitionBy(within).orderBy(by)))


def single_vs_multi(single: DataFrame, multi: DataFrame, keys: list[str]) -> DataFrame:
    """Mean score over cells: one model for all against one model per cell."""
    s = single.select(*keys, F.col("r2").alias("r2_s"), F.col("mae").alias("mae_s"))
    m = multi.select(*keys, F.col("r2").alias("r2_m"), F.col("mae").alias("mae_m"))
    return s.join(m, keys).agg(
        F.avg("r2_s").alias("r2_single"),
        F.avg("mae_s").alias("mae_single"),
        F.avg("r2_m").alias("r2_multi"),
        F.avg("mae_m").alias("mae_multi"),
    )


