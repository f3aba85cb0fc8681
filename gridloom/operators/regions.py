"""Regionalisation: clustering of cells by their features."""

from __future__ import annotations

from functools import partial
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.aggregate import box_stats, time_quantile_features
from gridloom.operators.density import components, density_clusters
from gridloom.operators.features import fill_sentinel, melt_features, minmax_column
from gridloom.operators.ranks import hash_order
from gridloom.sources.workspace import cut, stored


def cluster_features(
    static: DataFrame, forcing: DataFrame, values: list[str], kind: str = "mean_std"
) -> DataFrame:
    """Static columns beside the mean and deviation (or q10 and q90) of the forcing per cell."""
    if kind == "quantiles":
        return static.join(time_quantile_features(forcing, values), ["y", "x"], "left")
    moments = forcing.groupBy("y", "x").agg(
        *[F.avg(v).alias(f"{v}_mean") for v in values],
        *[F.stddev_pop(v).alias(f"{v}_std") for v in values],
    )
    return static.join(moments, ["y", "x"], "left")


def kmeans_regions(
    df: DataFrame, features: list[str], k: int, valid: str | None = None, seed: int = 0
) -> DataFrame:
    """k-means label per row; missing features count as a sentinel, rows without `valid` get none."""
    known = F.col(valid).isNotNull() if valid else F.lit(True)
    filled = fill_sentinel(df.withColumn("_known", known), features)
    vectors = VectorAssembler(inputCols=features, outputCol="_f").transform(filled)
    model = KMeans(k=k, seed=seed, featuresCol="_f", predictionCol="region").fit(vectors)
    out = model.transform(vectors).withColumn("region", F.when(F.col("_known"), F.col("region")))
    return out.drop("_f", "_known")


def kmeans_many(
    df: DataFrame, id_col: str, features: list[str], ks: list[int], rounds: int = 20, seed: int = 0
) -> DataFrame:
    """k-means for many k at once: (id, k, region); rows with a missing or non-finite feature get no region.

    The first k rows of a seeded hash order start as centres. A round is one pass for all k: a task assigns
    its rows and adds up their features by (k, region), and only these sums are shuffled. A centre without
    rows stays. Rounds end when no centre moves. The driver holds sum(ks) centres. Ties go to the smaller label.
    """
    values = F.array(*[F.col(f).cast("double") for f in features])
    bad = F.exists("at", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = stored(df.select(F.col(id_col).alias("id"), values.alias("at")), "vectors")
    whole = rows.filter(~bad)
    starts = whole.orderBy(hash_order(seed, "id"), "id").limit(max(ks)).select("at").collect()
    centres = {k: np.array([s["at"] for s in starts[:k]]).reshape(-1, len(features)) for k in ks}

    def assigned(batches, centres):
        for batch in batches:
            if batch.num_rows:
                at = batch.column("at").flatten().to_numpy().reshape(batch.num_rows, -1)
                yield batch.column("id"), at, {k: _nearest(at, c) for k, c in centres.items()}

    def summed(batches, centres):
        total = {k: np.zeros(c.shape) for k, c in centres.items()}
        count = {k: np.zeros(len(c), np.int64) for k, c in centres.items()}
        for _, at, regions in assigned(batches, centres):
            for k, region in regions.items():
                np.add.at(total[k], region, at)
                count[k] += np.bincount(region, minlength=len(count[k]))
        for k in centres:
            used = np.flatnonzero(count[k])
            columns = [np.full(len(used), k), used, count[k][used]]
            arrays = [pa.array(c.astype(np.int64)) for c in columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(list(total[k][used]), pa.list_(pa.float64()))], ["k", "region", "n", "total"])

    def labelled(batches, centres):
        for ids, _, regions in assigned(batches, centres):
            for k, region in regions.items():
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(ids), k, np.int32)), pa.array(region.astype(np.int32))], ["id", "k", "region"])

    for _ in range(rounds if starts else 0):
        parts = whole.mapInArrow(partial(summed, centres=centres), "k long, region long, n long, total array<double>")
        sums = (
            parts.select("k", "region", "n", F.posexplode("total").alias("i", "total"))
            .groupBy("k", "region", "i")
            .agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        )
        moved = {k: c.copy() for k, c in centres.items()}
        for s in sums.collect():
            moved[s["k"]][s["region"], s["i"]] = s["total"] / s["n"]
        settled = all(np.array_equal(moved[k], centres[k]) for k in ks)
        centres = moved
        if settled:
            break
    kind = rows.schema["id"].dataType.simpleString()
    known = whole.mapInArrow(partial(labelled, centres=centres), f"id {kind}, k int, region int")
    missing = rows.filter(bad).select(
        "id", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"), F.lit(None).cast("int").alias("region")
    )
    return known.unionByName(missing).withColumnRenamed("id", id_col)


def _nearest(at: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centre of each row, one centre at a time so that memory stays that of the rows."""
    best, label = np.full(len(at), np.inf), np.zeros(len(at), np.int64)
    for i, centre in enumerate(centres):
        gap = ((at - centre) ** 2).sum(axis=1)
        closer = gap < best
        best[closer], label[closer] = gap[closer], i
    return label


def kmeans_assign(df: DataFrame, centroids: DataFrame, features: list[str], label: str = "region") -> DataFrame:
    """Nearest of given centroids; ties go to the smaller label.

    The centroids (one row per label, as many as there are regions) come in as
    one array, so rows are neither multiplied nor shuffled.
    """
    table = centroids.agg(
        F.array_sort(F.collect_list(F.struct(label, F.array(*features).alias("at")))).alias("c")
    ).scalar()

    def distance(c: Column) -> Column:
        total = F.lit(0.0)
        for i, f in enumerate(features):
            gap = F.col(f) - c["at"][i]
            total = total + gap * gap
        return total

    nearest = F.array_min(F.transform("_c", lambda c: F.struct(distance(c).alias("d"), c[label].alias("l"))))
    return df.withColumn("_c", table).withColumn(label, nearest["l"]).drop("_c")


def cluster_profile(df: DataFrame, features: list[str], cluster: str) -> DataFrame:
    """Box statistics of the scaled features in every cluster."""
    scaled = minmax_column(df.select(cluster, *features), features)
    return box_stats(melt_features(scaled, [cluster], features), [cluster, "feature"], "value")


def _distance2(a: str, b: str, dims: int) -> Column:
    """Squared distance of two arrays, written out, which compiles to plain arithmetic."""
    total = F.lit(0.0)
    for i in range(dims):
        gap = F.get(a, F.lit(i)) - F.get(b, F.lit(i))
        total = total + gap * gap
    return total


INDEX_DIMS = 3  # up to here the grid itself finds neighbours, beyond it cells of `density` do


def _near_boxes(left: DataFrame, right: DataFrame, dims: int, eps: float) -> DataFrame:
    """Pairs (a, b) of different boxes that may hold points within eps (box diagonal = eps).

    Crowded or not, a box is one row here, and boxes meet on their grid coordinates.
    """
    reach = int(dims**0.5) + 1
    steps = [
        s for s in product(range(-reach, reach + 1), repeat=dims) if sum(max(abs(i) - 1, 0) ** 2 for i in s) <= dims
    ]

    def key(box: str, step: tuple[int, ...] | None = None) -> Column:
        return F.array(*[F.get(F.col(box), F.lit(i)) + (step[i] if step else 0) for i in range(dims)])

    gap = F.lit(0).cast("bigint")
    for i in range(dims):
        apart = F.greatest(F.abs(F.get("a", F.lit(i)) - F.get("b", F.lit(i))) - 1, F.lit(0))
        gap = gap + apart * apart
    return (
        left.select(F.col("box").alias("a"), F.explode(F.array(*[key("box", s) for s in steps])).alias("_k"))
        .join(right.select(F.col("box").alias("b"), key("box").alias("_k")), ["_k"])
        .filter((F.col("a") != F.col("b")) & (gap <= dims))
        .select("a", "b")
    )


def dbscan(df: DataFrame, id_col: str, features: list[str], eps: float, min_points: int) -> DataFrame:
    """Density clustering, exact: (id, cluster), -1 for noise.

    A cluster is named after its smallest core id; a border point joins the
    reachable cluster with the smallest name.

    Beyond three dimensions almost all boxes of a grid are neighbours; see `density_clusters`.
    Up to there space is cut into boxes whose diagonal is eps. All points of a box with at
    least `min_points` are core and belong together, so crowded boxes - and
    copies of one point, which are folded first - are never paired within.
    Points are compared only where one side's box is sparse (fewer than
    `min_points` points, hence a fixed number of partners per point); two
    crowded boxes are compared by shrinking sub-boxes.
    """
    dims = len(features)
    side = eps / dims**0.5
    vectors = F.array(*[F.col(f).cast("double") for f in features])
    flat = stored(df.select(id_col, vectors.alias("at")), "vectors").filter(~F.exists("at", lambda x: x.isNull() | F.isnan(x)))
    folded = flat.groupBy("at").agg(F.count(F.lit(1)).alias("w"), F.min(id_col).alias("pid"))
    if dims > INDEX_DIMS:
        return flat.join(density_clusters(folded, eps, min_points), ["at"]).select(id_col, "cluster")
    points = cut(folded.withColumn("box", F.transform("at", lambda x: F.floor(x / F.lit(side)).cast("bigint"))))
    boxes = stored(points.groupBy("box").agg(F.sum("w").alias("total")), "boxes")
    dense = boxes.filter(F.col("total") >= min_points)
    sparse = boxes.filter(F.col("total") < min_points)
    sparse_points = points.join(sparse.select("box", "total"), ["box"])

    # Every (sparse point, other point within eps in another box) pair.
    other = points.select(
        F.col("box").alias("other_box"), F.col("pid").alias("other"), F.col("w").alias("other_w"), F.col("at").alias("other_at")
    )
    near = cut(
        sparse_points.join(
            _near_boxes(sparse, boxes, dims, eps).withColumnsRenamed({"a": "box", "b": "other_box"}), ["box"]
        )
        .join(other, ["other_box"])
        .filter(_distance2("at", "other_at", dims) <= eps * eps)
        .select("pid", "box", "other", "other_w", "other_box")
    )
    reached = near.groupBy("pid").agg(F.sum("other_w").alias("outside"))
    sparse_core = (
        sparse_points.join(reached, ["pid"], "left")
        .filter(F.col("total") + F.coalesce("outside", F.lit(0)) >= min_points)
        .select("pid", "box")
    )
    core = cut(
        points.join(dense.select("box"), ["box"], "left_semi").select("pid", "box").unionByName(sparse_core)
    )
    nodes = core.groupBy("box").agg(F.min("pid").alias("label"))

    # Boxes joined through a pair of core points, one of them in a sparse box.
    cores = core.select("pid")
    through = (
        near.join(cores, ["pid"], "left_semi")
        .join(cores.withColumnRenamed("pid", "other"), ["other"], "left_semi")
        .select(F.col("box").alias("a"), F.col("other_box").alias("b"))
        .distinct()
    )
    crowded = _crowded_links(points, dense, dims, side, eps)
    links = through.unionByName(crowded)
    both_ways = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = components(nodes, both_ways)

    core_labels = core.join(labels, ["box"]).select("pid", F.col("label").alias("cluster"))
    # Border points: not core, but within eps of a core point of their own or another box.
    # (Only boxes with a core point are nodes, so only those have a label.)
    own = sparse_points.join(cores, ["pid"], "left_anti").join(labels, ["box"]).select(
        "pid", F.col("label").alias("cluster")
    )
    across = (
        near.join(cores, ["pid"], "left_anti")
        .join(core.select(F.col("pid").alias("other"), F.col("box").alias("_b")), ["other"])
        .join(labels.withColumnRenamed("box", "_b"), ["_b"])
        .select("pid", F.col("label").alias("cluster"))
    )
    border = own.unionByName(across).groupBy("pid").agg(F.min("cluster").alias("cluster"))
    known = core_labels.unionByName(border)
    named = points.join(known, ["pid"], "left").select("at", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
    return flat.join(named, ["at"]).select(id_col, "cluster")


def _bounds(dims: int) -> list[Column]:
    """Least and greatest value of every coordinate, as two arrays."""
    return [F.array(*[f(F.get("at", F.lit(i))) for i in range(dims)]).alias(name) for f, name in ((F.min, "lo"), (F.max, "hi"))]


def _crowded_links(points: DataFrame, dense: DataFrame, dims: int, side: float, eps: float) -> DataFrame:
    """Pairs of crowded boxes with two points within eps.

    Each round holds pairs of sub-boxes with the true bounds of their points.
    A pair whose farthest corners are within eps links its boxes; one whose
    nearest corners are not is dropped; the rest are split in half. Distinct
    points end as single-point sub-boxes, so the rounds end.
    """
    crowd = points.join(dense.select("box"), ["box"], "left_semi").select("box", "at")

    def parts(level: int) -> DataFrame:
        width = F.lit(side / 2**level)
        sub = F.transform("at", lambda x: F.floor(x / width).cast("bigint"))
        return crowd.groupBy("box", sub.alias("sub")).agg(*_bounds(dims))

    def named(df: DataFrame, tag: str) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{tag}_{c}") for c in df.columns])

    candidates = cut(_near_boxes(dense, dense, dims, eps).filter("a < b"))
    found = candidates.limit(0)
    open_pairs = None
    level = 0
    while True:
        table = parts(level)
        if open_pairs is None:
            paired = candidates.join(named(table, "p"), F.col("a") == F.col("p_box")).join(
                named(table, "q"), F.col("b") == F.col("q_box")
            )
        else:
            finer = table.withColumn("up", F.transform("sub", lambda x: F.floor(x / 2).cast("bigint")))
            left, right = named(finer, "p"), named(finer, "q")
            paired = open_pairs.join(
                left, (F.col("a") == F.col("p_box")) & (F.col("pa") == F.col("p_up"))
            ).join(right, (F.col("b") == F.col("q_box")) & (F.col("pb") == F.col("q_up")))
        right_of = F.zip_with("p_lo", "q_hi", lambda a, b: a - b)
        left_of = F.zip_with("q_lo", "p_hi", lambda a, b: a - b)
        gaps = F.zip_with(right_of, left_of, lambda a, b: F.greatest(F.lit(0.0), a, b))
        widths = F.zip_with(right_of, left_of, lambda a, b: F.greatest(-a, -b))
        nearest, farthest = (F.aggregate(c, F.lit(0.0), lambda total, x: total + x * x) for c in (gaps, widths))
        judged = cut(
            paired.select(
                "a",
                "b",
                F.col("p_sub").alias("pa"),
                F.col("q_sub").alias("pb"),
                (nearest <= eps * eps).alias("maybe"),
                (farthest <= eps * eps).alias("sure"),
            ).filter("maybe")
        )
        linked = judged.filter("sure").select("a", "b").distinct()
        found = cut(found.unionByName(linked))
        open_pairs = cut(judged.filter(~F.col("sure")).join(linked, ["a", "b"], "left_anti").select("a", "b", "pa", "pb"))
        if open_pairs.isEmpty():
            return found
        level += 1
