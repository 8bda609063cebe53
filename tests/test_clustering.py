import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.functions.metrics import register_python
from loomspark.operators import boxes as bx
from loomspark.operators.components import connected_components
from loomspark.operators.neighbors import neighbor_counts, neighbor_pairs
from loomspark.plans.model import DensityClusterer, DensityModel
from loomspark.settings import BoxSettings, ClusterSettings
from loomspark.sources.points import points, read_csv

SCHEMA = "id long, c array<double>"


def frame(spark, coords):
    return points(spark.createDataFrame([(i + 1, [float(x) for x in (c if isinstance(c, (list, tuple)) else [c])]) for i, c in enumerate(coords)], SCHEMA), "c", "id")


def brute(rows, eps, m, dist, border_as_noise=False):
    ids = list(rows)
    near = {a: [b for b in ids if dist(rows[a], rows[b]) <= eps] for a in ids}
    core = {a for a in ids if len(near[a]) >= m}
    root = {a: a for a in core}
    changed = True
    while changed:
        changed = False
        for a in core:
            low = min(root[b] for b in near[a] if b in core)
            if low < root[a]:
                root[a], changed = low, True
    out = {}
    for a in ids:
        over = [root[b] for b in near[a] if b in core]
        label = root[a] if a in core else (min(over) if over and not border_as_noise else 0)
        out[a] = (len(near[a]), a in core, label)
    return out


def fitted(df, **given):
    return {r["point_id"]: (r["n_neighbors"], r["is_core"], r["cluster_id"]) for r in DensityClusterer(**given).fit(df).labelled.collect()}


EUCLID = math.dist
MANHATTAN = lambda a, b: sum(abs(x - y) for x, y in zip(a, b, strict=True))
CHEBYSHEV = lambda a, b: max(abs(x - y) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize(("metric", "dist"), [("euclidean", EUCLID), ("manhattan", MANHATTAN), ("chebyshev", CHEBYSHEV)])
@pytest.mark.parametrize("dims", [1, 2, 4])
def test_random_points_against_brute_force(spark, metric, dist, dims):
    rng = random.Random(dims)
    rows = {i + 1: tuple(rng.randint(0, 12) / 2 for _ in range(dims)) for i in range(60)}
    df = frame(spark, list(rows.values()))
    for noise in (False, True):
        assert fitted(df, eps=1.0, min_points=4, metric=metric, border_as_noise=noise) == brute(rows, 1.0, 4, dist, noise)


def test_rules(spark):
    assert fitted(frame(spark, [0, 1]), eps=1, min_points=2) == {1: (2, True, 1), 2: (2, True, 1)}  # eps is inclusive
    assert fitted(frame(spark, [0]), eps=1, min_points=1) == {1: (1, True, 1)}  # a point counts itself
    assert fitted(frame(spark, [0]), eps=1, min_points=2) == {1: (1, False, 0)}
    assert {v[2] for v in fitted(frame(spark, [(0, 0)] * 3), eps=1, min_points=3).values()} == {1}  # duplicates
    got = fitted(frame(spark, [0, 0.2, 0.4, 1.3, 2.2, 2.4, 2.6]), eps=1, min_points=4)  # a border point joins no clusters
    assert [got[i][2] for i in range(1, 8)] == [3, 3, 3, 3, 5, 5, 5]
    assert fitted(frame(spark, [(0, 5), (0.5, 5), (9, 5)]), eps=1, min_points=2)[2] == (2, True, 1)  # a constant axis
    assert fitted(frame(spark, [1e7, 1e7 + 1, 1e7 + 2]), eps=1, min_points=2)[3] == (2, True, 1)
    assert fitted(frame(spark, [0, 0.6, 1.55, 3]), eps=1, min_points=2)[3] == (2, True, 1)
    assert fitted(frame(spark, [0.0, -0.0]), eps=0, min_points=2) == {1: (2, True, 1), 2: (2, True, 1)}


def test_layout_does_not_matter(spark):
    rng = random.Random(5)
    df = frame(spark, [(rng.random() * 8, rng.random() * 8) for _ in range(80)])
    one = fitted(df, eps=0.8, min_points=3)
    assert fitted(df.orderBy(F.rand(1)).repartition(7), eps=0.8, min_points=3) == one


def test_bad_rows_and_empty(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [float("nan")]), (3, None), (0, [1.0]), (4, [None])], SCHEMA)
    with pytest.raises(Exception, match="not a point"):
        points(df, "c", "id").collect()
    assert [r["point_id"] for r in points(df, "c", "id", mode="drop").collect()] == [1]
    assert fitted(points(df.where("false"), "c", "id"), eps=1, min_points=1) == {}
    with pytest.raises(ValueError, match="coordinates"):
        neighbor_pairs(points(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], SCHEMA), "c", "id"), 1)
    for bad in ({"eps": -1}, {"min_points": 0}):
        with pytest.raises(ValueError):
            ClusterSettings(**bad)


def test_predict_ladder_and_files(spark, tmp_path):
    train = frame(spark, [0, 0.2, 0.4, 0.6, 5.0, 5.6, 1.5])
    model = DensityClusterer(eps=1, min_points=4).fit(train)
    assert {r["point_id"]: r["cluster_id"] for r in model.labelled.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 0, 6: 0, 7: 1}
    assert model.predict_point(0.3) == 1
    assert model.predict_point(2.2) == 1  # one neighbour, the border point
    assert model.predict_point(5.3) == 0  # two noise points are too few
    assert DensityModel(model.labelled, ClusterSettings(1, 3)).predict_point(5.3) == -1
    assert DensityModel(model.labelled, ClusterSettings(1, 4, border_as_noise=True)).predict_point(2.2) == 0
    assert model.predict_point(100) == 0
    assert model.noise_points().count() == 2 and model.clustered_points().count() == 5
    assert {tuple(r) for r in model.summary().collect()} == {(0, 2, 0, 0), (1, 5, 4, 1)}
    model.save(f"{tmp_path}/model")
    assert DensityModel.load(spark, f"{tmp_path}/model").predict_point(0.3) == 1
    model.save_csv(f"{tmp_path}/csv")
    back = read_csv(spark, f"{tmp_path}/csv")
    assert sorted(tuple(r["coords"]) for r in back.collect()) == sorted((float(x), float(c)) for x, c in ((0, 1), (0.2, 1), (0.4, 1), (0.6, 1), (5, 0), (5.6, 0), (1.5, 1)))


def test_command_line(spark, tmp_path):
    from loomspark.plans.cli import main

    (tmp_path / "in.csv").write_text("0,0\n0,1\n9,9\n")
    main(["--input", f"{tmp_path}/in.csv", "--output", f"{tmp_path}/out", "--eps", "1", "--min-points", "2", "--levels", "1", "--points-per-box", "2", "--debug-output", f"{tmp_path}/debug"])
    lines = sorted(x for p in (tmp_path / "out").glob("part-*") for x in p.read_text().split())
    assert [x.split(",")[:2] for x in lines] == [["0.0", "0.0"], ["0.0", "1.0"], ["9.0", "9.0"]] and lines[2].endswith(",0")


def test_debug_outputs(spark):
    seen = {}
    DensityClusterer(eps=1, min_points=2, boxes=BoxSettings(levels=2, points_per_box=3), debug=lambda name, df: seen.update({name: df.collect()})).fit(frame(spark, [0, 0.5, 1.4, 2.2, 9, 20]))
    assert set(seen) == {"boxes", "placed", "partial", "mappings", "near_bounds", "summary"}
    assert sum(r["n_points"] for r in seen["boxes"]) == len(seen["placed"]) == 6
    assert {r["node"] for r in seen["partial"]} == {r["node"] for r in seen["mappings"]} and {r["cluster"] for r in seen["mappings"]} == {1}
    assert {r["path"] for r in seen["placed"]} <= {r["path"] for r in seen["boxes"]}
    assert {(r["point_id"], r["cluster_id"]) for r in seen["near_bounds"]} >= {(1, 1), (6, 0)}


def test_estimator(spark, tmp_path):
    from pyspark.ml.linalg import Vectors

    from loomspark.plans.ml import DensityClustering, DensityClusteringModel

    df = spark.createDataFrame([(i + 1, Vectors.dense([x]), "kept") for i, x in enumerate([0.0, 0.2, 0.4, 9.0])], ["id", "features", "other"])
    one = DensityClustering(eps=1.0, minPoints=3)
    one.save(f"{tmp_path}/estimator")
    assert DensityClustering.load(f"{tmp_path}/estimator").settings() == ClusterSettings(1.0, 3)
    model = one.fit(df)
    model.save(f"{tmp_path}/model")
    for m in (model, DensityClusteringModel.load(f"{tmp_path}/model")):
        assert {(r["id"], r["prediction"], r["other"]) for r in m.transform(df).collect()} == {(1, 1, "kept"), (2, 1, "kept"), (3, 1, "kept"), (4, 0, "kept")}


def test_dense_cell_writes_no_pairs(spark):
    from loomspark.plans import shared

    n = 100_000
    dense = spark.range(n).select((F.col("id") + 1).alias("id"), F.array((F.col("id") % 400) / 1e4, F.floor(F.col("id") / 400) / 1e4).alias("c"))
    df = points(dense.unionByName(spark.createDataFrame([(n + 1, [0.9, 0.0]), (n + 2, [50.0, 50.0])], SCHEMA)), "c", "id")
    before, written = shared.saved, {}

    def spy(df, name="table"):
        out = before(df, name)
        written[name] = max(written.get(name, 0), out.count())
        return out

    from loomspark.operators import components, labels, neighbors

    modules = (components, labels, neighbors)
    try:
        for m in modules:
            m.saved = spy
        got = DensityClusterer(eps=2, min_points=5).fit(df).labelled
        assert {tuple(r) for r in got.groupBy("n_neighbors", "is_core", "cluster_id").count().collect()} == {(n + 1, True, 1, n + 1), (1, False, 0, 1)}
    finally:
        for m in modules:
            m.saved = before
    assert max(written[x] for x in ("cells", "near", "edges")) < 10 and max(written.values()) <= n + 2


@pytest.mark.parametrize("metric", ["euclidean", "own"])
def test_many_coordinates_against_brute_force(spark, metric, monkeypatch):
    from loomspark.operators import blocks

    monkeypatch.setattr(blocks, "BLOCK_ROWS", 7)
    register_python("own", lambda a, b: np.abs(a - b).sum(1) / 4)
    rng = random.Random(4)
    rows = {i + 1: tuple(rng.randint(0, 3) / 2 for _ in range(9)) for i in range(70)}
    rows |= {71: rows[1], 72: rows[1], 73: (50.0,) * 9}
    dist = EUCLID if metric == "euclidean" else lambda a, b: MANHATTAN(a, b) / 4
    df = frame(spark, list(rows.values()))
    got = DensityClusterer(eps=1.5, min_points=5, metric=metric).fit(df)
    assert {r["point_id"]: (r["n_neighbors"], r["is_core"], r["cluster_id"]) for r in got.labelled.collect()} == brute(rows, 1.5, 5, dist)
    want = {(a, b) for a in rows for b in rows if a < b and dist(rows[a], rows[b]) <= 1.5}
    assert {(r["id_a"], r["id_b"]) for r in neighbor_pairs(df, 1.5, metric).collect()} == want
    label = {r["point_id"]: r["cluster_id"] for r in got.labelled.collect()}
    votes = {i: Counter(label[j] for j in rows if dist(rows[i], rows[j]) <= 1.5) for i in rows}
    for r in got.predict(df).collect():
        strong = [c for c, n in votes[r["point_id"]].items() if c and n >= 4]
        any_ = [c for c in votes[r["point_id"]] if c]
        assert r["cluster_id"] == (min(strong) if strong else min(any_) if any_ else -1 if votes[r["point_id"]][0] >= 4 else 0)


def test_interval_and_box_operators(spark):
    one = spark.createDataFrame([(0.0, 10.0)], "a double, b double")
    pieces = lambda *more: [tuple(p) for p in one.select(bx.split_interval(F.col("a"), F.col("b"), *more).alias("p")).first()["p"]]
    assert pieces(4) == [(0.0, 2.5, False), (2.5, 5.0, False), (5.0, 7.5, False), (7.5, 10.0, True)]
    assert pieces(8, 4.0) == [(0.0, 10 / 3, False), (10 / 3, 20 / 3, False), (20 / 3, 10.0, True)] and pieces(8, 40.0) == [(0.0, 10.0, True)]
    a, b = F.col("a"), F.col("b")
    assert tuple(one.select(bx.length(a, b), *bx.extended(a, b, F.lit(2.0)), *bx.hull((a, b), (F.lit(-1.0), F.lit(3.0))), bx.interval_contains(b, a, b), bx.interval_contains(b, a, b, True)).first()) == (10.0, -1.0, 11.0, -1.0, 10.0, False, True)
    got = bx.around(frame(spark, [(1, 2)]), 3.0).first()
    assert (got["lo"], got["hi"]) == ([-0.5, 0.5], [2.5, 3.5])
    boxes = bx.density_boxes(frame(spark, [(i, i * i) for i in range(9)]), 0.1, BoxSettings(levels=3, points_per_box=2, splits=3))
    assert tuple(bx.embracing(boxes, 2).first()) == ([0.0, 0.0], [8.0, 64.0])
    centres = [r["centre"] for r in bx.by_centre(boxes, 2).collect()]
    assert centres == sorted(centres) and len(centres) == boxes.count()
    with pytest.raises(Exception, match="no box holds point"):
        bx.assign(frame(spark, [(99, 99)]), boxes, 0.1, BoxSettings(levels=3, points_per_box=2, splits=3)).collect()
    placed = bx.assign(frame(spark, [(i, i * i) for i in range(9)]), boxes, 0.1, BoxSettings(levels=3, points_per_box=2, splits=3))
    pairs = {tuple(r) for r in bx.adjacent(boxes).collect()}
    near = {(r["point_id"], r["path"]) for r in bx.near_bounds(placed, 0.5).collect()}
    assert sorted((r["path_a"], r["path_b"], r["point_id"]) for r in bx.near_pairs(placed, boxes, 0.5).collect()) == sorted((x, y, i) for x, y in pairs for i, p in near if p in (x, y))
    laid = bx.partition_by_box(placed, 3).withColumn("part", F.spark_partition_id()).collect()
    assert len({(r["path"], r["part"]) for r in laid}) == len({r["path"] for r in laid})


def test_saved_tables_go_with_their_scope(spark):
    import glob

    from loomspark.plans.shared import saved, scope, shared_dir

    with scope():
        kept = saved(spark.range(3), "scoped")
        assert kept.count() == 3
    assert not glob.glob(f"{shared_dir(spark)}/*-scoped")


def test_stream_scoring(spark, tmp_path):
    from loomspark.streaming.scoring import score_stream

    model = DensityClusterer(eps=1, min_points=2).fit(frame(spark, [0, 0.5]))
    frame(spark, [0.2, 7.0]).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("point_id long, coords array<double>").parquet(f"{tmp_path}/in")
    score_stream(model, stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(60)
    assert {(r["point_id"], r["cluster_id"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {(1, 1), (2, 0)}


def test_python_metric(spark):
    register_python("taxi_test", lambda a, b: abs(a - b).sum(1))
    df = frame(spark, [(0, 0), (1, 0), (1, 1), (5, 5)])
    assert {(r["id_a"], r["id_b"]) for r in neighbor_pairs(df, 1, "taxi_test").collect()} == {(1, 2), (2, 3)}
    assert {r["point_id"]: r["n_neighbors"] for r in neighbor_counts(df, 1).collect()} == {1: 2, 2: 3, 3: 2, 4: 1}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7), (None, 3)]
    root = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in root:
        for a, b in edges:
            if a in root and b in root and a != b:
                root[a] = root[b] = min(root[a], root[b])
    for one_task in (0, 1000):
        got = connected_components(spark.createDataFrame(edges, "src long, dst long").repartition(5), one_task=one_task)
        assert {r["node"]: r["component"] for r in got.collect()} == root
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_boxes(spark):
    rng = random.Random(9)
    df = frame(spark, [(rng.random() * 9, rng.random() * 5, rng.random()) for _ in range(300)])
    s = BoxSettings(levels=4, points_per_box=60)
    boxes = bx.density_boxes(df, 0.1, s)
    got = bx.assign(df, boxes, 0.1, s).collect()
    assert sorted(r["point_id"] for r in got) == list(range(1, 301))
    for r in got:
        assert all(a <= x <= b for x, a, b in zip(r["coords"], r["lo"], r["hi"], strict=True))
    assert sum(r["n_points"] for r in boxes.collect()) == 300
    assert bx.adjacent(boxes).count() > 0
    assert bx.density_boxes(df.where("false"), 0.1, s).count() == 0
    assert len(bx.equal_grid([0.0, 0.0], [3.0, 1.0], 4, 0.9)) == 3
