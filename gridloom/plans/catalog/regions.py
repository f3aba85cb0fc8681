"""Regionalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import features, regions
from gridloom.plans.catalog.aggregation import _BOX
from gridloom.plans.catalog.base import DEM, EMB, PAIR, query, r
from gridloom.sources import tables
from gridloom.sources.workspace import stored

_F = tables.FEATURES


def _static(spark, sf):
    return tables.dem(spark, sf)


_STATS = f"""{DEM}, {PAIR}, m as (select y, x, avg(truth) as truth_mean, avg(pred) as pred_mean,
  stddev_pop(truth) as truth_std, stddev_pop(pred) as pred_std from pair group by 1, 2)"""


@query(
    "cluster_features",
    f"""with {_STATS} select y, x, {r('elevation')} as elevation, {r('truth_mean')} as truth_mean,
      {r('pred_mean')} as pred_mean, {r('truth_std')} as truth_std, {r('pred_std')} as pred_std
      from dem left join m using (y, x)""",
)
def cluster_features(spark, sf):
    return regions.cluster_features(_static(spark, sf), tables.pair(spark, sf), ["truth", "pred"])


@query(
    "cluster_features_quantiles",
    f"""with {DEM}, {PAIR}, m as (select y, x, {", ".join(f"quantile_cont({v}, {p}) as {v}_{n}" for v in ("truth", "pred") for p, n in ((0.1, 10), (0.9, 90)))}
        from pair group by 1, 2)
      select y, x, {r('elevation')} as elevation,
        {", ".join(f"{r(f'{v}_{n}')} as {v}_{n}" for v in ("truth", "pred") for n in (10, 90))} from dem left join m using (y, x)""",
)
def cluster_features_quantiles(spark, sf):
    return regions.cluster_features(
        _static(spark, sf), tables.pair(spark, sf), ["truth", "pred"], "quantiles"
    )


@query("kmeans_regions")
def kmeans_regions(spark, sf):
    cells = regions.cluster_features(_static(spark, sf), tables.pair(spark, sf), ["truth", "pred"])
    names = ["elevation", "truth_mean", "pred_mean", "truth_std", "pred_std"]
    return regions.kmeans_regions(stored(cells), names, 6).select("y", "x", "region")


_KS, _ROUNDS = [5, 6, 20, 50], 4


def _lloyd(i: int) -> str:
    """One round: the nearest centre of every vector for every k, then the means; unused centres stay."""
    return f"""a{i} as (select vec_id, vec, k, cluster from (
        select vec_id, e.vec, c.k, c.cluster, row_number() over (partition by vec_id, c.k order by list_distance(e.vec, c.vec), c.cluster) as j
        from e, c{i} c) where j = 1),
      u{i} as (select k, cluster, unnest(vec) as v, generate_subscripts(vec, 1) as p from a{i}),
      m{i} as (select k, cluster, list(v order by p) as vec from (select k, cluster, p, avg(v) as v from u{i} group by 1, 2, 3) group by 1, 2),
      c{i + 1} as (select c.k, c.cluster, coalesce(m.vec, c.vec) as vec from c{i} c left join m{i} m using (k, cluster))"""


@query(
    "kmeans_many",
    f"""with {EMB}, ks as (select unnest({_KS}) as k),
      e as (select vec_id, cast([{", ".join(_F)}] as double[]) as vec from emb
        where {" and ".join(f"isfinite({f})" for f in _F)}),
      c0 as (select k, i - 1 as cluster, vec from (select vec, row_number() over (order by md5('0|' || vec_id), vec_id) as i from e), ks where i <= k),
      {", ".join(_lloyd(i) for i in range(_ROUNDS + 1))}
      select emb.vec_id, cast(ks.k as int) as k, cast(cluster as int) as region
      from emb cross join ks left join a{_ROUNDS} a on a.vec_id = emb.vec_id and a.k = ks.k""",
)
def kmeans_many(spark, sf):
    """Four numbers of regions in the same passes, after a fixed number of rounds."""
    return regions.kmeans_many(tables.emb(spark, sf), "vec_id", _F, _KS, rounds=_ROUNDS)


@query(
    "kmeans_assign",
    f"""with {EMB}, c as (select label, {", ".join(f"avg({f}) as c{i}" for i, f in enumerate(_F))} from emb group by 1),
      dist as (select vec_id, c.label as region, {" + ".join(f"({f} - c{i}) * ({f} - c{i})" for i, f in enumerate(_F))} as dd
        from emb, c),
      k as (select *, row_number() over (partition by vec_id order by dd, region) as i from dist)
      select vec_id, region from k where i = 1""",
)
def kmeans_assign(spark, sf):
    emb = tables.emb(spark, sf)
    centroids = emb.groupBy(F.col("label").alias("region")).agg(*[F.avg(f).alias(f) for f in _F])
    return regions.kmeans_assign(emb, centroids, _F).select("vec_id", "region")


_LONG = f"""{EMB}, e as (select {", ".join(f"min({f}) as lo_{f}, max({f}) as hi_{f}" for f in _F)} from emb),
  long as ({" union all ".join(f"select label, '{f}' as feature, ({f} - lo_{f}) / nullif(hi_{f} - lo_{f}, 0) as value from emb, e" for f in _F)})"""


@query(
    "cluster_profile",
    f"""with {_LONG}, {_BOX.format('label, feature')}
      select label, feature, {r('q1')} as q1, {r('median')} as median, {r('q3')} as q3,
        {r('min(value) filter (inside)')} as whisker_low, {r('max(value) filter (inside)')} as whisker_high,
        count(*) filter (not inside) as outliers, count(*) as n from f group by label, feature, q1, median, q3""",
)
def cluster_profile(spark, sf):
    return regions.cluster_profile(tables.emb(spark, sf), _F, "label")


_SCALED = f"""{EMB}, e as (select min(f0) as a0, max(f0) as b0, min(f1) as a1, max(f1) as b1 from emb),
  p as (select vec_id, (f0 - a0) / nullif(b0 - a0, 0) as u, (f1 - a1) / nullif(b1 - a1, 0) as v from emb, e),
  n as (select a.vec_id as i, b.vec_id as j from p a join p b
    on (a.u - b.u) * (a.u - b.u) + (a.v - b.v) * (a.v - b.v) <= 0.05::double * 0.05::double),
  core as (select i from n group by i having count(*) >= 5),
  link as (select i, j from n where i in (select i from core) and j in (select i from core)),
  reach(i, root) as (select i, i from core union select link.j, reach.root from reach join link on link.i = reach.i),
  lab as (select i, min(root) as cluster from reach group by i),
  border as (select n.i, min(lab.cluster) as cluster from n join lab on lab.i = n.j
    where n.i not in (select i from core) group by n.i)"""


@query(
    "dbscan_regions",
    f"""with recursive {_SCALED} select vec_id, coalesce(lab.cluster, border.cluster, -1) as cluster
      from p left join lab on lab.i = vec_id left join border on border.i = vec_id""",
)
def dbscan_regions(spark, sf):
    two = ["f0", "f1"]
    scaled = features.minmax_column(tables.emb(spark, sf).select("vec_id", *two), two)
    return regions.dbscan(scaled, "vec_id", two, 0.05, 5)


_ALL = f"""{EMB}, e as (select {", ".join(f"min({f}) as lo_{f}, max({f}) as hi_{f}" for f in _F)} from emb),
  p as (select vec_id, {", ".join(f"({f} - lo_{f}) / nullif(hi_{f} - lo_{f}, 0) as {f}" for f in _F)} from emb, e),
  n as (select a.vec_id as i, b.vec_id as j from p a join p b
    on {" + ".join(f"(a.{f} - b.{f}) * (a.{f} - b.{f})" for f in _F)} <= 1.6::double * 1.6::double),
  core as (select i from n group by i having count(*) >= 5),
  link as (select i, j from n where i in (select i from core) and j in (select i from core)),
  reach(i, root) as (select i, i from core union select link.j, reach.root from reach join link on link.i = reach.i),
  lab as (select i, min(root) as cluster from reach group by i),
  border as (select n.i, min(lab.cluster) as cluster from n join lab on lab.i = n.j
    where n.i not in (select i from core) group by n.i)"""


@query(
    "dbscan_regions_all_features",
    f"""with recursive {_ALL} select vec_id, coalesce(lab.cluster, border.cluster, -1) as cluster
      from p left join lab on lab.i = vec_id left join border on border.i = vec_id""",
)
def dbscan_regions_all_features(spark, sf):
    scaled = features.minmax_column(tables.emb(spark, sf).select("vec_id", *_F), _F)
    return regions.dbscan(scaled, "vec_id", _F, 1.6, 5)
