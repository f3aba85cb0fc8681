"""Wall-clock per query, as one JSON line.

Environment: BENCH_SF_DIR (data folder), BENCH_CPUS (local cores), BENCH_ALL=1
(every registered query instead of the headline ones), BENCH_KEYS (a list).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "scan_files", "level_pivot", "variable_split", "index_window", "match_time", "write_cube",
    "daily_mean", "daily_sum_mm", "daily_first", "shift_then_daily", "daily_shift_one", "monthly_sum",
    "leadtime_stitch", "regrid_bilinear", "regrid_bilinear_cube", "regrid_conservative", "dem_slope",
    "dem_aspect", "static_broadcast", "tile_id", "elevation_bands", "anomaly", "anomaly_standardized",
    "minmax_period", "zscore_sample", "valid_cells", "cell_series", "merge_vars", "pair_truth_pred",
    "three_way", "area_mean_coslat", "annual_cycle", "year_quantile", "global_summary",
    "correlation_matrix", "box_stats", "r2_pooled_anom", "r2_by_cell", "skill_yearly_abs",
    "pearson_total", "extreme_skill", "wet_day_freq_skipna", "model_vs_reference", "crps",
    "crps_box_month", "spread_error_mse", "rps_terciles", "rank_histogram", "qm_basic",
    "split_stratified", "split_timeseries", "fit_predict_cells_linear", "fit_predict_ensemble",
    "cv_rmse_cells", "single_vs_multi", "kmeans_assign", "cluster_profile", "dbscan_regions", "kmeans_regions",
    "fit_predict_cells", "fit_predict_cells_boosted", "fit_predict_cells_levelwise", "fit_predict_cells_adaboost",
    "cv_rmse_cells_boosted", "global_rf", "global_gbt_leafwise", "feature_importance", "tree_stump", "regrid_curvilinear",
    "regrid_curvilinear_conservative",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from gridloom.plans.catalog import load

    registered, _ = load()
    keys = HEADLINE
    if os.environ.get("BENCH_ALL"):
        keys = list(registered)
    if os.environ.get("BENCH_KEYS"):
        keys = os.environ["BENCH_KEYS"].split(",")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").write.format("noop").mode("overwrite").save()
    times = {}
    for key in keys:
        start = time.perf_counter()
        registered[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - start, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(key, times[key], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total wall-clock of the queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
