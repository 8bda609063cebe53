"""Registered queries of the clustering engine and their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.metrics import almost_at_least, almost_at_most, almost_equal, metric
from loomspark.operators import boxes as bx
from loomspark.operators import labels
from loomspark.operators import neighbors as nb
from loomspark.operators.components import connected_components
from loomspark.settings import BoxSettings, ClusterSettings
from loomspark.sources.points import points, profile

EPS, MIN_POINTS = 1.505, 6
BOXES = BoxSettings(levels=6, points_per_box=100)
CENTER = [70.0, 100.0]
EVENTS = "SELECT event_id + 1 AS id, CAST(user_id AS DOUBLE) AS x, value AS y FROM events"
VECTORS = "SELECT vec_id + 1 AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("event_id") + 1).alias("id"), F.col("user_id").alias("x"), F.col("value").alias("y"))
    return points(df, ["x", "y"], "id")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select((F.col("vec_id") + 1).alias("id"), "embedding")
    return points(df, "embedding", "id")


def _xy() -> list:
    return [F.col("coords")[0].alias("x"), F.col("coords")[1].alias("y")]


def points_scan(spark, sf_dir):
    return _events(spark, sf_dir).select("point_id", *_xy())


def pairwise_distance(spark, sf_dir):
    return nb.neighbor_pairs(_events(spark, sf_dir), EPS).select("id_a", "id_b", F.floor(F.col("distance") * 1000000).alias("micro_distance"))


def distance_from_origin(spark, sf_dir, name="euclidean"):
    return _events(spark, sf_dir).select("point_id", F.floor(metric(name).from_origin(F.col("coords"), 2) * 1000000).alias("micro_norm"))


def eps_ball(spark, sf_dir):
    return nb.eps_ball(_events(spark, sf_dir), CENTER, 40.005).select("point_id")


def almost_on_bounds(spark, sf_dir):
    """Points whose first coordinate is the lower or upper bound of their density box, within TOLERANCE."""
    x, lo, hi = F.col("coords")[0], F.col("lo")[0], F.col("hi")[0]
    side = [almost_equal(x, lo).alias("at_lower"), almost_equal(x, hi).alias("at_upper"), (almost_at_least(x, lo) & almost_at_most(x, hi)).alias("inside")]
    return _assigned(spark, sf_dir).select("point_id", *side)


def bounding_box(spark, sf_dir):
    return bx.bounding_box(_events(spark, sf_dir))


def _flat(boxes: DataFrame) -> DataFrame:
    return boxes.select("path", "lvl", F.col("lo")[0].alias("xl"), F.col("hi")[0].alias("xu"), F.col("lo")[1].alias("yl"), F.col("hi")[1].alias("yu"), "n_points")


def density_boxes(spark, sf_dir):
    return _flat(bx.density_boxes(_events(spark, sf_dir), EPS, BOXES))


def _assigned(spark, sf_dir):
    pts = _events(spark, sf_dir)
    return bx.assign(pts, bx.density_boxes(pts, EPS, BOXES), EPS, BOXES)


def box_assignment(spark, sf_dir):
    return _assigned(spark, sf_dir).select("point_id", "path")


def adjacent_boxes(spark, sf_dir):
    return bx.adjacent(bx.density_boxes(_events(spark, sf_dir), EPS, BOXES))


def points_near_bounds(spark, sf_dir):
    return bx.near_bounds(_assigned(spark, sf_dir), EPS).select("point_id", "path")


def near_bound_pairs(spark, sf_dir):
    pts = _events(spark, sf_dir)
    boxes = bx.density_boxes(pts, EPS, BOXES)
    return bx.near_pairs(bx.assign(pts, boxes, EPS, BOXES), boxes, EPS).select("path_a", "path_b", "point_id")


def points_by_box(spark, sf_dir):
    """The layout by box: which points stand together in a partition, as counts and bounds of ids that hold for any layout."""
    laid = bx.partition_by_box(_assigned(spark, sf_dir)).withColumn("part", F.spark_partition_id())
    return laid.groupBy("path").agg(F.count("*").alias("n_points"), F.min("point_id").alias("first_id"), F.max("point_id").alias("last_id"), F.count_distinct("part").alias("n_partitions"))


def boxes_by_centre(spark, sf_dir):
    boxes = bx.density_boxes(_events(spark, sf_dir), EPS, BOXES)
    return bx.by_centre(boxes, 2).select("path", F.col("centre")[0].alias("x"), F.col("centre")[1].alias("y"))


def embracing_box(spark, sf_dir):
    both = bx.embracing(bx.density_boxes(_events(spark, sf_dir), EPS, BOXES), 2)
    return both.select(F.col("lo")[0].alias("xl"), F.col("hi")[0].alias("xu"), F.col("lo")[1].alias("yl"), F.col("hi")[1].alias("yu"))


def boxes_around_points(spark, sf_dir):
    """Boxes of side 2 * EPS around points, their sides' lengths, and whether the point itself is inside."""
    b = bx.around(_events(spark, sf_dir), 2 * EPS)
    lo, hi = F.col("lo"), F.col("hi")
    return b.select("point_id", lo[0].alias("xl"), hi[0].alias("xu"), lo[1].alias("yl"), hi[1].alias("yu"), bx.length(lo[0], hi[0]).alias("side"), bx.box_contains(F.col("coords"), lo, hi, 2).alias("inside"))


def interval_hulls(spark, sf_dir):
    """The side of each density box on the first axis, grown by EPS, and its hull with the interval [0, 1]."""
    boxes = bx.density_boxes(_events(spark, sf_dir), EPS, BOXES)
    own = F.col("lo")[0], F.col("hi")[0]
    wide, both = bx.extended(*own, F.lit(EPS)), bx.hull(own, (F.lit(0.0), F.lit(1.0)))
    return boxes.select("path", wide[0].alias("wide_lower"), wide[1].alias("wide_upper"), both[0].alias("hull_lower"), both[1].alias("hull_upper"))


def interval_pieces(spark, sf_dir):
    """Each side of the bounding box in at most 8 pieces of about 25 at least."""
    side = bx.bounding_box(_events(spark, sf_dir))
    pieces = side.select("dim", F.posexplode(bx.split_interval(F.col("lower"), F.col("upper"), 8, 25.0)).alias("piece", "p"))
    return pieces.select("dim", "piece", "p.lower", "p.upper", "p.upper_inclusive")


def equal_grid(spark, sf_dir):
    """The bounding box in at most 4 parts a side, none shorter than 30, with the points of each."""
    pts = _events(spark, sf_dir)
    p = profile(pts)
    parts = [(i, *a, *b) for i, (a, b) in enumerate(bx.equal_grid(list(p.lower), list(p.upper), 4, 30.0))]
    return spark.createDataFrame(parts, "part long, xl double, yl double, xu double, yu double")


def cells(spark, sf_dir):
    return nb.cells(_events(spark, sf_dir), EPS).select(F.col("cell")[0].alias("cx"), F.col("cell")[1].alias("cy"), "n_points")


def neighbor_pairs(spark, sf_dir):
    return nb.neighbor_pairs(_events(spark, sf_dir), EPS).select("id_a", "id_b")


def neighbor_counts(spark, sf_dir):
    return nb.neighbor_counts(_events(spark, sf_dir), EPS)


def core_points(spark, sf_dir):
    return nb.neighbor_counts(_events(spark, sf_dir), EPS, min_points=MIN_POINTS).where("is_core").select("point_id", "n_neighbors")


def _core(spark, sf_dir):
    """Neighbour search and core points of events, each at its own place or not."""
    pts = _events(spark, sf_dir)
    s = nb.search(pts, EPS)
    return pts, s, labels.counted_places(pts, s, ClusterSettings(EPS, MIN_POINTS)).where("is_core")


def core_edges(spark, sf_dir):
    pts, s, core = _core(spark, sf_dir)
    points_of = nb.at_places(pts, core.select("loc", "weight", "coords"), s.dims)
    return nb.neighbor_pairs(points_of.select("point_id", "coords"), EPS).select("id_a", "id_b")


def components(spark, sf_dir):
    pts, s, core = _core(spark, sf_dir)
    clusters, _, _ = labels.core_clusters(core, s)
    found = clusters.select("loc", F.lit(1).alias("weight"), "coords", F.col("cluster").alias("component"))
    return nb.at_places(pts, found, s.dims).select("point_id", "component")


def _labelled(spark, sf_dir, view=_events, **given):
    return labels.label(view(spark, sf_dir), ClusterSettings(**({"eps": EPS, "min_points": MIN_POINTS} | given)))


def border_assignment(spark, sf_dir):
    return _labelled(spark, sf_dir).where("is_border").select("point_id", "cluster_id")


def cluster_labels(spark, sf_dir, **given):
    return _labelled(spark, sf_dir, **given).select("point_id", "n_neighbors", "is_core", "cluster_id")


def noise_points(spark, sf_dir):
    return labels.noise_points(_labelled(spark, sf_dir)).select("point_id", "n_neighbors")


def clustered_points(spark, sf_dir):
    return labels.clustered_points(_labelled(spark, sf_dir)).select("point_id", "cluster_id")


def cluster_summary(spark, sf_dir):
    return labels.summary(_labelled(spark, sf_dir))


def predict_labels(spark, sf_dir):
    from loomspark.plans.shared import saved

    pts, s = _events(spark, sf_dir), ClusterSettings(EPS, MIN_POINTS)
    return labels.predict(saved(labels.label(pts, s), "labelled"), pts, s)


VEC = {"view": _vectors, "eps": 1.15, "min_points": 3}


def vector_neighbor_counts(spark, sf_dir):
    return nb.neighbor_counts(_vectors(spark, sf_dir), 1.15)


def vector_labels(spark, sf_dir):
    return _labelled(spark, sf_dir, **VEC).select("point_id", "n_neighbors", "is_core", "cluster_id")


QUERIES = {f.__name__: f for f in (
    points_scan, pairwise_distance, distance_from_origin, bounding_box, density_boxes, box_assignment, adjacent_boxes, points_near_bounds, cells,
    neighbor_pairs, neighbor_counts, core_points, core_edges, border_assignment, cluster_labels, noise_points, clustered_points, cluster_summary,
    predict_labels, vector_neighbor_counts, vector_labels, eps_ball, almost_on_bounds, near_bound_pairs, points_by_box, boxes_by_centre,
    embracing_box, boxes_around_points, interval_hulls, interval_pieces, equal_grid,
)} | {
    "connected_components": components,
    "manhattan_norm": partial(distance_from_origin, name="manhattan"),
    "chebyshev_norm": partial(distance_from_origin, name="chebyshev"),
    "cluster_labels_border_as_noise": partial(cluster_labels, border_as_noise=True),
    "manhattan_labels": partial(cluster_labels, metric="manhattan"),
    "chebyshev_labels": partial(cluster_labels, metric="chebyshev"),
}

_DIST = {
    "euclidean": "sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))",
    "manhattan": "abs(a.x-b.x)+abs(a.y-b.y)",
    "chebyshev": "greatest(abs(a.x-b.x), abs(a.y-b.y))",
    "vector": "list_distance(a.v, b.v)",
}


def _cte(src: str = EVENTS, eps: float = EPS, m: int = MIN_POINTS, metric: str = "euclidean") -> str:
    near = "" if metric == "vector" else f"b.x BETWEEN a.x-{eps} AND a.x+{eps} AND "
    return f"""WITH RECURSIVE p AS ({src}),
nb AS (SELECT a.id, b.id AS nid FROM p a JOIN p b ON {near}{_DIST[metric]} <= {eps}),
cnt AS (SELECT id, count(*) AS n FROM nb GROUP BY id),
core AS (SELECT id FROM cnt WHERE n >= {m}),
e AS (SELECT nb.id, nb.nid FROM nb JOIN core c1 ON nb.id=c1.id JOIN core c2 ON nb.nid=c2.id WHERE nb.id<>nb.nid),
cc(id, root) USING KEY (id) AS (
  SELECT id, id FROM core UNION
  SELECT e.nid, min(cc.root) FROM cc JOIN e ON cc.id=e.id JOIN recurring.cc AS o ON o.id=e.nid WHERE cc.root < o.root GROUP BY e.nid),
lab AS (SELECT nb.id, min(cc.root) AS r FROM nb JOIN cc ON cc.id=nb.nid GROUP BY nb.id),
out AS (SELECT p.id AS point_id, cnt.n AS n_neighbors, (cnt.n>={m}) AS is_core, (cc.id IS NULL AND lab.id IS NOT NULL) AS is_border,
  CASE WHEN cc.id IS NOT NULL THEN cc.root WHEN lab.id IS NOT NULL THEN lab.r ELSE 0 END AS cluster_id
  FROM p JOIN cnt USING(id) LEFT JOIN cc USING(id) LEFT JOIN lab USING(id))
"""


_LABELS = "SELECT point_id, n_neighbors, is_core, cluster_id FROM out"
# a point's leaf is what its way down the tree says, level by level; boxes then meet points by an equi-join on the path
_BOXES = f"""WITH RECURSIVE p AS MATERIALIZED ({EVENTS}),
n AS MATERIALIZED (
 SELECT '0' AS path, 0 AS lvl, min(x) xl, max(x) xu, min(y) yl, max(y) yu FROM p
 UNION ALL
 SELECT path||k, lvl+1,
   CASE WHEN sx AND k=1 THEN xl+(xu-xl)/2 ELSE xl END, CASE WHEN sx AND k=0 THEN xl+(xu-xl)/2 ELSE xu END,
   CASE WHEN NOT sx AND k=1 THEN yl+(yu-yl)/2 ELSE yl END, CASE WHEN NOT sx AND k=0 THEN yl+(yu-yl)/2 ELSE yu END
 FROM (SELECT *, (xu-xl)>=(yu-yl) AS sx FROM n) t, (VALUES (0),(1)) v(k)
 WHERE lvl<{BOXES.levels} AND least(CASE WHEN sx THEN (xu-xl)/2 ELSE xu-xl END, CASE WHEN sx THEN yu-yl ELSE (yu-yl)/2 END) >= 2*{EPS}),
way AS (
 SELECT id, x, y, '0' AS path FROM p
 UNION ALL
 SELECT id, x, y, way.path || CASE WHEN (CASE WHEN n.xu-n.xl>=n.yu-n.yl THEN x >= n.xl+(n.xu-n.xl)/2 ELSE y >= n.yl+(n.yu-n.yl)/2 END) THEN '1' ELSE '0' END
 FROM way JOIN n ON n.path = way.path WHERE EXISTS (SELECT 1 FROM n AS kid WHERE kid.path = way.path || '0')),
inb AS MATERIALIZED (SELECT path, id FROM way),
c AS MATERIALIZED (SELECT n.path, count(inb.id) AS cnt FROM n LEFT JOIN inb USING(path) GROUP BY n.path),
s AS MATERIALIZED (SELECT left(path,length(path)-1) AS par, max(cnt) AS mx FROM c GROUP BY 1),
boxes AS MATERIALIZED (SELECT n.path, n.lvl, n.xl, n.xu, n.yl, n.yu, c.cnt AS n_points FROM n JOIN c USING(path)
 LEFT JOIN s AS kids ON kids.par=n.path
 LEFT JOIN s AS sib  ON sib.par=left(n.path,length(n.path)-1)
WHERE (n.lvl=0 OR sib.mx>={BOXES.points_per_box}) AND coalesce(kids.mx,0)<{BOXES.points_per_box})
"""
_ADJACENT = "SELECT a.path AS path_a, b.path AS path_b FROM boxes a JOIN boxes b ON a.path<b.path AND a.xl<=b.xu AND b.xl<=a.xu AND a.yl<=b.yu AND b.yl<=a.yu"
_NEAR = f"SELECT p.id AS point_id, path FROM inb JOIN boxes USING(path) JOIN p ON p.id=inb.id WHERE abs(x-xl)<={EPS} OR abs(x-xu)<={EPS} OR abs(y-yl)<={EPS} OR abs(y-yu)<={EPS}"
_SIDES = f"SELECT min(x) xl, max(x) xu, min(y) yl, max(y) yu FROM ({EVENTS})"

ORACLES = {
    "points_scan": EVENTS.replace("AS id", "AS point_id"),
    "pairwise_distance": _cte() + f"SELECT a.id AS id_a, b.id AS id_b, CAST(floor({_DIST['euclidean']}*1000000) AS BIGINT) AS micro_distance FROM nb JOIN p a ON a.id=nb.id JOIN p b ON b.id=nb.nid WHERE nb.id<nb.nid",
    "distance_from_origin": f"SELECT id AS point_id, CAST(floor(sqrt(x*x+y*y)*1000000) AS BIGINT) AS micro_norm FROM ({EVENTS})",
    "bounding_box": f"WITH p AS ({EVENTS}) SELECT 0::INTEGER AS dim, min(x) AS lower, max(x) AS upper, count(*) AS n_points FROM p UNION ALL SELECT 1::INTEGER, min(y), max(y), count(*) FROM p",
    "density_boxes": _BOXES + "SELECT * FROM boxes",
    "box_assignment": _BOXES + "SELECT inb.id AS point_id, path FROM inb JOIN boxes USING(path)",
    "adjacent_boxes": _BOXES + _ADJACENT,
    "points_near_bounds": _BOXES + _NEAR,
    "near_bound_pairs": _BOXES.rstrip() + f",\nnear AS MATERIALIZED ({_NEAR}), adj AS MATERIALIZED ({_ADJACENT})\nSELECT path_a, path_b, point_id FROM near JOIN adj ON path = path_a UNION ALL SELECT path_a, path_b, point_id FROM near JOIN adj ON path = path_b",
    "points_by_box": _BOXES + "SELECT path, count(*) AS n_points, min(id) AS first_id, max(id) AS last_id, 1::BIGINT AS n_partitions FROM inb JOIN boxes USING(path) GROUP BY path",
    "boxes_by_centre": _BOXES + "SELECT path, xl+(xu-xl)/2 AS x, yl+(yu-yl)/2 AS y FROM boxes ORDER BY x, y",
    "embracing_box": _BOXES + "SELECT min(xl) AS xl, max(xu) AS xu, min(yl) AS yl, max(yu) AS yu FROM boxes",
    "almost_on_bounds": _BOXES + "SELECT p.id AS point_id, abs(x-xl)<=1e-10 AS at_lower, abs(x-xu)<=1e-10 AS at_upper, x>=xl-1e-10 AND x<=xu+1e-10 AS inside FROM inb JOIN boxes USING(path) JOIN p ON p.id=inb.id",
    "interval_hulls": _BOXES + f"SELECT path, xl-{EPS}/2.0::DOUBLE AS wide_lower, xu+{EPS}/2.0::DOUBLE AS wide_upper, least(xl, 0.0::DOUBLE) AS hull_lower, greatest(xu, 1.0::DOUBLE) AS hull_upper FROM boxes",
    "boxes_around_points": f"SELECT id AS point_id, x-{EPS}::DOUBLE AS xl, x+{EPS}::DOUBLE AS xu, y-{EPS}::DOUBLE AS yl, y+{EPS}::DOUBLE AS yu, (x+{EPS}::DOUBLE)-(x-{EPS}::DOUBLE) AS side, true AS inside FROM ({EVENTS})",
    "interval_pieces": f"""SELECT dim, k::INTEGER AS piece, lo+k*(hi-lo)/n AS lower, CASE WHEN k=n-1 THEN hi ELSE lo+(k+1)*(hi-lo)/n END AS upper, k=n-1 AS upper_inclusive
FROM (SELECT *, unnest(range(n)) AS k FROM (SELECT *, greatest(1, least(8, floor((hi-lo)/25+0.5)::INTEGER)) AS n FROM (SELECT 0::INTEGER AS dim, xl AS lo, xu AS hi FROM ({_SIDES}) UNION ALL SELECT 1, yl, yu FROM ({_SIDES}))))""",
    "equal_grid": f"""SELECT i*ny+j AS part, xl+i*(xu-xl)/nx AS xl, yl+j*(yu-yl)/ny AS yl, CASE WHEN i=nx-1 THEN xu ELSE xl+(i+1)*(xu-xl)/nx END AS xu, CASE WHEN j=ny-1 THEN yu ELSE yl+(j+1)*(yu-yl)/ny END AS yu
FROM (SELECT *, unnest(range(ny)) AS j FROM (SELECT *, unnest(range(nx)) AS i FROM (SELECT *, greatest(1, least(4, floor((xu-xl)/30+0.5)::INTEGER)) AS nx, greatest(1, least(4, floor((yu-yl)/30+0.5)::INTEGER)) AS ny FROM ({_SIDES}))))""",
    "eps_ball": f"SELECT id AS point_id FROM ({EVENTS}) WHERE sqrt((x-{CENTER[0]})*(x-{CENTER[0]})+(y-{CENTER[1]})*(y-{CENTER[1]})) <= 40.005",
    "manhattan_norm": f"SELECT id AS point_id, CAST(floor((abs(x)+abs(y))*1000000) AS BIGINT) AS micro_norm FROM ({EVENTS})",
    "chebyshev_norm": f"SELECT id AS point_id, CAST(floor(greatest(abs(x), abs(y))*1000000) AS BIGINT) AS micro_norm FROM ({EVENTS})",
    "cells": f"SELECT CAST(floor(x/{EPS}) AS BIGINT) AS cx, CAST(floor(y/{EPS}) AS BIGINT) AS cy, count(*) AS n_points FROM ({EVENTS}) GROUP BY 1, 2",
    "neighbor_pairs": _cte() + "SELECT id AS id_a, nid AS id_b FROM nb WHERE id<nid",
    "neighbor_counts": _cte() + "SELECT id AS point_id, n AS n_neighbors FROM cnt",
    "core_points": _cte() + f"SELECT id AS point_id, n AS n_neighbors FROM cnt WHERE n>={MIN_POINTS}",
    "core_edges": _cte() + "SELECT id AS id_a, nid AS id_b FROM e WHERE id<nid",
    "connected_components": _cte() + "SELECT id AS point_id, root AS component FROM cc",
    "border_assignment": _cte() + "SELECT point_id, cluster_id FROM out WHERE is_border",
    "cluster_labels": _cte() + _LABELS,
    "cluster_labels_border_as_noise": _cte() + "SELECT point_id, n_neighbors, is_core, CASE WHEN is_core THEN cluster_id ELSE 0 END AS cluster_id FROM out",
    "noise_points": _cte() + "SELECT point_id, n_neighbors FROM out WHERE cluster_id=0",
    "clustered_points": _cte() + "SELECT point_id, cluster_id FROM out WHERE cluster_id<>0",
    "cluster_summary": _cte() + "SELECT cluster_id, count(*) AS n_points, count(*) FILTER (is_core) AS n_core, count(*) FILTER (is_border) AS n_border FROM out GROUP BY cluster_id",
    "predict_labels": _cte() + f""", l AS MATERIALIZED (SELECT t.cluster_id, p.x, p.y FROM out t JOIN p ON p.id=t.point_id),
qp AS (SELECT * FROM ({EVENTS})),
g AS (SELECT qp.id, l.cluster_id, count(*) n FROM qp JOIN l ON l.x BETWEEN qp.x-{EPS} AND qp.x+{EPS} AND sqrt((qp.x-l.x)*(qp.x-l.x)+(qp.y-l.y)*(qp.y-l.y)) <= {EPS} GROUP BY ALL),
a AS (SELECT id, min(cluster_id) FILTER (cluster_id<>0 AND n>={MIN_POINTS}-1) AS strong, min(cluster_id) FILTER (cluster_id<>0) AS anyc, coalesce(max(n) FILTER (cluster_id=0),0) AS noise FROM g GROUP BY id)
SELECT qp.id AS point_id, CASE WHEN strong IS NOT NULL THEN strong WHEN anyc IS NOT NULL THEN anyc WHEN coalesce(noise,0)>={MIN_POINTS}-1 THEN -1 ELSE 0 END AS cluster_id FROM qp LEFT JOIN a USING(id)""",
    "manhattan_labels": _cte(metric="manhattan") + _LABELS,
    "chebyshev_labels": _cte(metric="chebyshev") + _LABELS,
    "vector_neighbor_counts": _cte(VECTORS, 1.15, 3, "vector") + "SELECT id AS point_id, n AS n_neighbors FROM cnt",
    "vector_labels": _cte(VECTORS, 1.15, 3, "vector") + _LABELS,
}
