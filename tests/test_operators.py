"""Hand-computed and analytic cases.

Fixed values: the four points and cells of test_small_grids, the class list of test_classes and the squares of test_polygons are given fixtures.
"""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratamesh.functions.geometry import IDENTITY, Bounds, compose, grid_shape
from stratamesh.operators import cloud_distance, cylinder, features, filters, grid, neighbors, point_index, quantiles, raster, registration, sampling, statistics, thinning
from stratamesh.operators.clip import INLINE_EDGES, ClipArea, clip, clip_statistics
from stratamesh.operators.estimator import NearestNeighbors
from stratamesh.operators.transforms import LocalFrame, apply_transform, local_frame, matrix_from_text, matrix_to_text


def cloud(spark, xyz, classification=2):
    xyz = np.asarray(xyz, float).reshape(-1, 3)
    return spark.createDataFrame([(i, *map(float, p), classification) for i, p in enumerate(xyz)], "point_id long, x double, y double, z double, classification int")


def turned(degrees, t):
    a = math.radians(degrees)
    return [[math.cos(a), -math.sin(a), 0, t[0]], [math.sin(a), math.cos(a), 0, t[1]], [0, 0, 1, t[2]], [0, 0, 0, 1]]


def test_uplift(spark):
    rng = np.random.default_rng(0)
    xy = rng.uniform(0, 10, (1000, 2))
    z = 0.1 * xy[:, 0] + 0.2 * xy[:, 1]
    a, b = cloud(spark, np.c_[xy, z]), cloud(spark, np.c_[xy, z + 1])
    row = grid.dod_statistics(grid.dod(a, b)).first()
    assert row["mean_change"] == pytest.approx(1) and row["rmse"] == pytest.approx(1)


def test_small_grids(spark):
    pts = cloud(spark, [(1, 1, 10), (1.5, 1.5, 20), (1.8, 1.2, 30), (5, 5, 100)])
    b = Bounds(0, 0, 10, 10)
    assert grid_shape(b, 1.0) == (11, 11)
    got = {(r["cell_x"], r["cell_y"]): r["value"] for r in grid.dem(pts, b, 2.0).collect()}
    assert got == {(0, 0): 20.0, (2, 2): 100.0}
    out = cloud(spark, [(5, 5, 100), (15, 15, 50), (25, 25, 200), (12, 18, 75)])
    assert grid.dem(out, Bounds(10, 10, 20, 20), 1.0, clamp=False).count() == 2
    assert grid.dem(out, Bounds(10, 10, 20, 20), 1.0).count() == 4
    with pytest.raises(ValueError):
        grid.dem(out, b, 1.0, "mode")
    with pytest.raises(ValueError):
        grid.bounds_of(pts.limit(0))
    assert grid.dem(pts.limit(0), b, 1.0).count() == 0


def test_partition_invariance(spark):
    rng = np.random.default_rng(3)
    pts = cloud(spark, np.c_[rng.uniform(0, 10, (2000, 2)), rng.normal(size=2000)])
    one = {(r[0], r[1]): r[2] for r in grid.dem(pts.coalesce(1), Bounds(0, 0, 10, 10), 1.0).collect()}
    many = {(r[0], r[1]): r[2] for r in grid.dem(pts.repartition(13), Bounds(0, 0, 10, 10), 1.0).collect()}
    assert one.keys() == many.keys() and all(one[k] == pytest.approx(many[k], rel=1e-10) for k in one)


def test_classes(spark):
    pts = spark.createDataFrame([(c,) for c in [1, 2, 2, 3, 2, 1, 5, 2]], "classification int")
    n = lambda **k: filters.filter_classes(pts, **k).count()
    assert (n(), n(classes=[1, 2, 3]), n(ground_only=False), n(classes=[1, 5])) == (4, 7, 8, 3)
    assert filters.filter_statistics(pts.limit(0)).first()["percent"] == 0


def test_polygons(spark):
    square, hole = [(0, 0), (100, 0), (100, 100), (0, 100)], [(25, 25), (75, 25), (75, 75), (25, 75)]
    assert ClipArea.of([square]).area == 10_000 and ClipArea.of([square, hole]).area == 7_500
    tri = ClipArea.of([[(0, 0), (100, 0), (50, 100)]])
    pts = cloud(spark, [(50, 30, 0), (50, 90, 0), (5, 90, 0), (95, 90, 0)])
    assert sorted(r["point_id"] for r in clip(pts, tri).collect()) == [0, 1]
    assert ClipArea.from_geojson(tri.to_geojson()) == tri
    many = ClipArea.of([[(50 + 40 * math.cos(t), 50 + 40 * math.sin(t)) for t in np.linspace(0, 2 * math.pi, INLINE_EDGES * 2, endpoint=False)]])
    rng = np.random.default_rng(1)
    p = rng.uniform(0, 100, (3000, 2))
    far = np.hypot(p[:, 0] - 50, p[:, 1] - 50)
    p = p[np.abs(far - 40) > 0.05]
    assert clip(cloud(spark, np.c_[p, np.zeros(len(p))]), many).count() == (np.hypot(p[:, 0] - 50, p[:, 1] - 50) < 40).sum()
    row = clip_statistics(pts, tri).first()
    assert (row["total"], row["inside"], row["outside"]) == (4, 2, 2)
    two = '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"name":"a"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[10,0],[10,10],[0,10],[0,0]]]}},{"type":"Feature","properties":{"name":"b"},"geometry":{"type":"Polygon","coordinates":[[[20,0],[30,0],[30,10],[20,10],[20,0]]]}}]}'
    assert ClipArea.from_geojson(two).area == 200 and ClipArea.from_geojson(two, "b").bounds.min_x == 20
    with pytest.raises(ValueError):
        ClipArea.from_geojson(two, "c")


def test_transforms(spark):
    m = turned(90, (0, 0, 0))
    r = apply_transform(cloud(spark, [(1, 0, 0)]), m).first()
    assert (r["x"], r["y"], r["z"]) == pytest.approx((0, 1, 0))
    assert matrix_from_text(matrix_to_text(m)) == [[float(v) for v in row] for row in m]
    with pytest.raises(ValueError):
        matrix_from_text("1 2 3")
    f = LocalFrame(466_000, 6_650_000)
    pts = cloud(spark, [(466_100, 6_650_200, 150)])
    r = f.to_local(pts).first()
    assert (r["x"], r["y"], r["z"]) == (100, 200, 150)
    assert f.to_global(f.to_local(pts)).first() == pts.first()
    assert LocalFrame.from_json(f.to_json()) == f and LocalFrame.from_json('{"offset_x": 1}').offset_y == 0
    assert local_frame(pts, "first_point", include_z=True).offset_z == 150
    with pytest.raises(ValueError):
        local_frame(pts.limit(0))
    assert compose(m, IDENTITY) == [[float(v) for v in row] for row in m]
    b = Bounds(1, 2, 3, 4)
    assert f.bounds_to_global(f.bounds_to_local(b)) == b
    assert b.intersects(Bounds(3, 4, 5, 6)) and not b.intersects(Bounds(3.1, 0, 4, 9))


def brute(a, b):
    return np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))


@pytest.mark.parametrize("most", [point_index.MOST, 0])
def test_neighbours(spark, monkeypatch, most):
    monkeypatch.setattr(point_index, "MOST", most)  # 0: no cloud is small
    rng = np.random.default_rng(5)
    a, b = rng.uniform(0, 10, (100, 3)), rng.uniform(0, 10, (130, 3))
    d = brute(a, b)
    s, t = cloud(spark, a), cloud(spark, b)
    assert neighbors.near_pairs(neighbors.sources(s), neighbors.targets(t), 1.5).count() == (d <= 1.5).sum()
    got = {(r["source_id"], r["rank"]): r["distance"] for r in neighbors.knn(s, t, 7, 0.3, 20.0).collect()}
    want = np.sort(d, 1)
    assert len(got) == 700 and all(got[i, k + 1] == pytest.approx(want[i, k]) for i in range(100) for k in range(7))
    assert neighbors.knn(s, t.limit(3), 7, 0.3, 30.0).count() == 300
    near = {r["source_id"]: r["distance"] for r in cloud_distance.distances_within(s, t, 1.0).collect()}
    assert all(near[i] == pytest.approx(want[i, 0]) if want[i, 0] <= 1 else near[i] == math.inf for i in range(100))
    stats = statistics.distance_statistics(cloud_distance.nearest(s, s)).first()
    assert (stats["n"], stats["mean"], stats["rmse"]) == (100, 0, 0)
    none = statistics.distance_statistics(cloud_distance.distances_within(s, t, 1.0), cutoff=-1.0).first()
    assert none["n"] == 0 and math.isnan(none["mean"]) and none["rmse"] == math.inf
    with pytest.raises(ValueError):
        cloud_distance.distances_within(s, t, None)


def test_neighbours_of_lonely_sources(spark, monkeypatch):
    monkeypatch.setattr(point_index, "MOST", 0)
    rng = np.random.default_rng(9)
    a = np.r_[rng.uniform(0, 10, (60, 3)), rng.uniform(900, 1000, (5, 3))]
    b = np.r_[rng.uniform(0, 10, (300, 3)), [(500, 500, 0)] * 2]
    want = np.sort(brute(a, b), 1)
    for lonely in (2000, 0):
        monkeypatch.setattr(neighbors, "LONELY", lonely)
        got = {(r["source_id"], r["rank"]): (r["distance"], r["target_id"]) for r in neighbors.knn(cloud(spark, a), cloud(spark, b), 3).collect()}
        assert len(got) == 195 and all(got[i, k + 1][0] == pytest.approx(want[i, k]) for i in range(65) for k in range(3))
        assert all(got[i, 1][1] == 300 for i in range(60, 65))  # of two alike, the lesser id


def test_point_index_edges():
    one = point_index.PointIndex(np.array([7]), np.zeros((1, 3)))
    query, rank, point, d2 = one.nearest(np.array([[3.0, 4.0, 0.0]]), 5)
    assert (one.ids[point].tolist(), rank.tolist(), d2.tolist()) == ([7], [1], [25.0])
    assert len(one.nearest(np.zeros((0, 3)), 1)[0]) == 0 and len(one.nearest(np.ones((1, 3)), 1, 0.5)[0]) == 0


def test_vertical_plane(spark):
    rng = np.random.default_rng(6)
    xy = rng.uniform(0, 20, (400, 2))
    target = np.c_[xy, 0.3 * xy[:, 0] - 0.2 * xy[:, 1] + 5]
    p = rng.uniform(5, 15, (30, 2))
    source = np.c_[p, 0.3 * p[:, 0] - 0.2 * p[:, 1] + 5.5]
    for k in ({"radius": 3.0}, {"k": 15}):
        got = [r["distance"] for r in cloud_distance.vertical_distances(cloud(spark, source), cloud(spark, target), **k).collect()]
        assert got == pytest.approx([0.5] * 30)
    far = cloud_distance.vertical_distances(cloud(spark, [(500, 500, 0)]), cloud(spark, target), radius=1.0).first()
    assert far["distance"] is None and far["target_id"] == -1


def test_cylinders(spark):
    rng = np.random.default_rng(7)
    xy = rng.uniform(0, 20, (2500, 2))
    slope = lambda p: 0.5 * p[:, 0]
    n = np.array([-0.5, 0, 1]) / math.sqrt(1.25)
    a = np.c_[xy, slope(xy)] + rng.normal(size=(2500, 1)) * 0.01 * n
    b = a + 0.4 * n
    cores = cloud(spark, [(10, 10, 5), (12, 8, 6), (300, 300, 0)])
    p = cylinder.CylinderParams(2.0, 1.5, 1.5)
    got = {r["core_id"]: r for r in cylinder.compare(cores, cloud(spark, a), cloud(spark, b), p).collect()}
    for i, core in ((0, (10, 10, 5)), (1, (12, 8, 6))):
        assert got[i]["distance"] == pytest.approx(0.4, abs=0.01) and 0 < got[i]["uncertainty"] < 0.01
        rel = a - np.array(core)
        t = rel @ n
        assert abs(got[i]["n1"] - ((np.abs(t) <= 1.5) & ((rel**2).sum(1) - t * t <= 2.25)).sum()) <= 1
    assert got[2]["distance"] is None and got[2]["n1"] == 0
    with pytest.raises(NotImplementedError):
        cylinder.compare_planes()
    t = cylinder.tuned(16 / math.pi)
    assert (t.cylinder_radius, t.max_depth, t.min_neighbors) == (1.0, 0.6, 8)
    with pytest.raises(ValueError):
        cylinder.autotune(cores.limit(0))


@pytest.mark.parametrize("most", [point_index.MOST, 0])
def test_registration(spark, monkeypatch, most):
    monkeypatch.setattr(point_index, "MOST", most)
    rng = np.random.default_rng(8)
    p = rng.normal(size=(1500, 3)) * (10, 5, 2)
    m = np.array(turned(5, (1.5, -0.7, 0.3)))
    q = p @ m[:3, :3].T + m[:3, 3]
    a, b = cloud(spark, p), cloud(spark, q)
    before = registration.registration_error(a, b, 5.0)
    got = registration.icp(a, b, reach=5.0, iterations=25)
    assert got.rmse < 0.8 * before
    assert np.allclose(registration.centroid_transform(a, cloud(spark, p + (2.3, -1.1, 0.4)))[0][3], 2.3)
    assert registration.score(a, b, registration.axes_transform(a, b)) < 0.5 * registration.score(a, b, IDENTITY)
    shifted = registration.phase_transform(a, cloud(spark, p + (7.0, -4.0, 0)), 0.5)
    assert abs(shifted[0][3] - 7) < 0.5 and abs(shifted[1][3] + 4) < 0.5 and shifted[2][3] == 0
    with pytest.raises(ValueError):
        registration.phase_transform(a, b, 0.0)
    assert registration.coarse(a, b, "none") == IDENTITY and registration.coarse(a.limit(0), b, "pca") == IDENTITY
    empty = registration.icp(a.limit(0), b)
    assert empty.rmse == math.inf and empty.matrix == IDENTITY
    pairs = spark.createDataFrame([(*map(float, x), *map(float, y)) for x, y in zip(p[:50], q[:50])], "sx double, sy double, sz double, tx double, ty double, tz double")
    assert np.allclose(registration.rigid_fit(registration.pair_sums(pairs).first()), m)


def test_features(spark):
    rng = np.random.default_rng(16)
    xy = rng.uniform(-30, 30, (9000, 2))
    x, y = xy.T
    p = np.c_[xy, 2 * np.sin(x / 6) + np.cos(y / 5) + 3 * np.exp(-((x - 9) ** 2 + (y + 5) ** 2) / 40) + 2 * np.sin((x + 2 * y) / 7)]
    m = np.array(turned(60, (12, -9, 3)))
    got = features.feature_transform(cloud(spark, p[::2]), cloud(spark, p[1::2] @ m[:3, :3].T + m[:3, 3]), 1.5)
    assert np.allclose(np.array(got)[:3, :3], m[:3, :3], atol=0.02) and np.allclose(np.array(got)[:3, 3], m[:3, 3], atol=0.3)
    assert features.feature_transform(cloud(spark, p[:3]), cloud(spark, p), 1.5) is None
    same = rng.normal(size=(50, 8))
    assert (features.mutual(same, same[::-1]) == np.stack([np.arange(50), np.arange(50)[::-1]], 1)).all()
    assert features.agreed_move(p[:2], p[:2], 1.0) is None


def test_quantiles_of_many_values(spark, monkeypatch):
    rng = np.random.default_rng(12)
    for v in (rng.normal(size=4000), np.round(rng.normal(size=4000)), np.zeros(50), np.array([3.0])):
        df = spark.createDataFrame([(float(x),) for x in v], "v double")
        at = [0.0, 0.05, 0.5, 0.95, 1.0]
        for most in (quantiles.AT_ONCE, 10):
            monkeypatch.setattr(quantiles, "AT_ONCE", most)
            assert quantiles.quantiles(df, "v", at, len(v)) == pytest.approx(np.quantile(v, at).tolist())
    assert quantiles.quantiles(df, "v", [0.5], 0) == [None]
    none = statistics.sign_summary(df.limit(0), "v").first()
    assert none["n"] == 0 and none["median"] is None and none["p95_abs"] is None
    assert statistics.distance_report(df.limit(0), "v").first()["percent_significant"] == 0
    assert statistics.change_statistics(df.limit(0), "v").first()["n_valid"] == 0


def test_percent_of_one_crowded_group(spark):
    pts = cloud(spark, [(i % 50, i // 50, 0) for i in range(3000)]).withColumn("g", F.when(F.col("point_id") < 2990, "a"))
    got = {(r["g"], r["point_id"]) for r in sampling.percent_per(pts, ["g"], 7.0).select("g", "point_id").collect()}
    by_hash = lambda ids: sorted(ids, key=lambda i: hashlib.md5(f"{i}:0".encode()).hexdigest())
    assert got == {("a", i) for i in by_hash(range(2990))[:209]} | {(None, by_hash(range(2990, 3000))[0])}


def test_octree(spark):
    rng = np.random.default_rng(15)
    p = rng.uniform(0, 8, (400, 3))
    got = {r["point_id"] for r in thinning.octree(cloud(spark, p), 2, (0, 0, 0), 8.0).collect()}
    best = {}
    for i, q in enumerate(p):
        cell = tuple(np.minimum(q // 2, 3).astype(int))
        best[cell] = min(best.get(cell, (9e9, 0)), (((q - (np.array(cell) + 0.5) * 2) ** 2).sum(), i))
    assert got == {i for _, i in best.values()}
    assert thinning.octree(cloud(spark, p), 0).count() == 1 and thinning.octree(cloud(spark, p).limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        thinning.octree(cloud(spark, p), 21)


def test_tiles(spark):
    pts = cloud(spark, [(i % 10, i // 10, i) for i in range(100)])
    seen = grid.map_tiles(pts, Bounds(0, 0, 10, 10), 5.0, 1.0, lambda a, b: a.iloc[:1].assign(n=len(a), m=len(b))[["n", "m"]], "n long, m long").collect()
    assert sorted((r["tile_i"], r["tile_j"], r["n"], r["m"]) for r in seen) == [(0, 0, 25, 36), (0, 1, 25, 36), (1, 0, 25, 36), (1, 1, 25, 36)]
    assert grid.in_tiles_meeting(pts, Bounds(0, 0, 10, 10), 5.0, Bounds(6, 6, 7, 7)).count() == 25
    with pytest.raises(ValueError):
        NearestNeighbors().kneighbors(pts)
    own = NearestNeighbors(2).fit(pts)
    assert all(r["source_id"] == r["target_id"] for r in own.kneighbors().where("rank = 1").collect())
    assert own.radius_neighbors(radius=1.5).where("source_id = 0").count() >= 1


def test_samples_and_raster(spark):
    pts = cloud(spark, [(i % 10, i // 10, i) for i in range(100)])
    assert sampling.sample(pts, 30).count() == 30 and sampling.sample(pts, 1000).count() == 100
    assert sorted(r[0] for r in sampling.sample(pts.repartition(7), 30).select("point_id").collect()) == sorted(r[0] for r in sampling.sample(pts, 30).select("point_id").collect())
    assert sampling.percent_per(pts.withColumn("g", F.col("point_id") % 7), ["g"], 1.0).count() == 7
    assert sampling.core_points(pts, 500.0).count() == 100 and sampling.core_points(pts, 5.0, count=3).count() == 3
    r = {(r["row"], r["col"]): r["value"] for r in raster.interpolate(pts, "z", 1.0).collect()}
    assert len(r) == 100 and r[9, 0] == 0 and r[0, 9] == 99
    lone = {(r["row"], r["col"]): r["value"] for r in raster.interpolate(cloud(spark, [(0, 0, 7)]), "z", 1.0, Bounds(0, 0, 9, 0)).collect()}
    assert lone[0, 0] == 7 and lone[0, 1] == 7 and lone[0, 2] == raster.NODATA
    dirty = cloud(spark, [*[(i * 0.5, 0, 0) for i in range(50)], (1000, 0, 0)])
    assert thinning.without_outliers(dirty, 4, 2.0).count() == 50
    h = statistics.histogram(spark.createDataFrame([(0.0,), (1.0,), (0.49,), (2.0,)], "d double"), "d", 0.0, 1.0, 2).collect()
    assert {x["bin"]: x["n"] for x in h} == {1: 2, 2: 1}
    assert math.isnan(statistics.pearson(spark.createDataFrame([(1.0, 2.0)], "a double, b double"), "a", "b").first()["r"])
