"""File search, multi-year reads and cube output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.numeric import nan_to_null


def scan_files(
    spark: SparkSession,
    folder: str,
    pattern: str,
    schema: T.StructType,
    years: tuple[int, int] | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    """Read every file below `folder` whose path matches a regular expression.

    Adds `file` (path) and `file_year` (last four-digit year in the part of the
    path that the pattern matches, 0 if none). The path test prunes files before
    they are opened.
    """
    path = F.col("_metadata.file_path")
    year = F.coalesce(
        F.try_to_number(
            F.regexp_extract(F.regexp_extract(path, pattern, 0), r".*(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)", 1), F.lit("9999")
        ).cast("int"),
        F.lit(0),
    )
    files = (
        spark.read.schema(schema)
        .option("recursiveFileLookup", "true")
        .format(fmt)
        .load(folder)
        .filter(path.rlike(pattern))
        .select("*", path.alias("file"), year.alias("file_year"))
    )
    if years:
        files = files.filter(F.col("file_year").between(*years))
    return nan_to_null(files)


def read_years(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Concatenate yearly cubes along time in one scan."""
    return nan_to_null(spark.read.parquet(*paths))


def concat_time(*parts: DataFrame) -> DataFrame:
    """Concatenate cubes along time; columns are matched by name."""
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part, allowMissingColumns=True)
    return first


def exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def write_cube(
    df: DataFrame,
    path: str,
    run_key: str,
    by: tuple[str, ...] = ("year",),
    overwrite: bool = False,
) -> bool:
    """Write predictions under a run key, partitioned by year (and member).

    Returns False without computing anything when the run is already there and
    `overwrite` is off. Rows are rebalanced by output folder: small folders get
    one file, a folder too large for one task is split over several.
    """
    spark = df.sparkSession
    target = f"{path}/run_key={run_key}"
    if not overwrite and exists(spark, f"{target}/_SUCCESS"):
        return False
    (
        df.withColumn("year", F.year("time"))
        .hint("rebalance", *by)
        .write.mode("overwrite")
        .partitionBy(*by)
        .option("compression", "zstd")
        .parquet(target)
    )
    return True


def write_trials(df: DataFrame, path: str) -> None:
    """Tuning log as CSV with a header."""
    df.write.mode("overwrite").option("header", "true").csv(path)


def split_variables(df: DataFrame, ids: list[str], variables: list[str]) -> DataFrame:
    """One row per variable: the table behind one output folder per variable."""
    return df.unpivot(ids, variables, "variable", "value")


def write_variables(long: DataFrame, path: str, by: tuple[str, ...] = ("variable", "level")) -> None:
    """Write a long table as one folder per variable (and level)."""
    long.write.mode("overwrite").partitionBy(*by).option("compression", "zstd").parquet(path)
