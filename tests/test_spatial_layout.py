"""Layouts by place: what is opened for a box, bounds without rows, crowded places, odd rows; and clouds over the bound of an index."""

import random

import pytest

from stratamesh.functions.geometry import Bounds
from stratamesh.operators import neighbors, point_index, sampling
from stratamesh.sources import layout
from stratamesh.sources.points import lineitem_points, scan_points
from stratamesh.staging import stage_path


def cloud(spark, rows):
    return spark.createDataFrame(rows, "point_id long, x double, y double, z double")


def test_morton_key_takes_bits_in_turn(spark):
    b = Bounds(0.0, 0.0, 8.0, 8.0)
    got = cloud(spark, [(8 * y + x, float(x), float(y), 0.0) for x in range(8) for y in range(8)]).select("x", "y", layout.morton_key(b, bits=3).alias("k")).collect()
    for r in got:
        x, y = int(r["x"]), int(r["y"])
        assert r["k"] == sum((x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1 for i in range(3))
    far = cloud(spark, [(1, 1e9, 1e9, 0.0), (2, -5.0, None, 0.0)]).select(layout.morton_key(Bounds(0, 0, 1, 1)).alias("k")).collect()
    assert [r["k"] for r in far] == [(1 << 48) - 1, None]


def test_a_box_opens_only_files_that_meet_it(spark, sf):
    pts = lineitem_points(spark, sf)
    path = stage_path(spark, "layout-test")
    boxes = layout.write_layout(pts, path, 16).collect()
    assert sum(r["n_points"] for r in boxes) == pts.count() and len(boxes) > 8
    b = Bounds(100.0, 100.0, 260.0, 240.0)
    got = layout.scan_box(spark, path, b)
    want = pts.where(f"x BETWEEN {b.min_x} AND {b.max_x} AND y BETWEEN {b.min_y} AND {b.max_y}")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
    assert 0 < len(got.inputFiles()) <= len(boxes) // 2
    assert layout.scan_box(spark, path, Bounds(-9.0, -9.0, -8.0, -8.0)).count() == 0
    plan = layout.layout_bounds(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "/boxes" in plan and "/points" not in plan


def test_crowded_and_odd_places(spark):
    rng = random.Random(1)
    rows = [(i, 5.0, 5.0, float(i)) for i in range(3_000)] + [(10_000 + i, rng.random() * 10, rng.random() * 10, 0.0) for i in range(3_000)]
    rows += [(-1, None, 1.0, 0.0), (-2, float("nan"), 1.0, 0.0), (-3, float("inf"), 1.0, 0.0)] + [(7, 5.0, 5.0, 7.0)] * 2
    path = stage_path(spark, "layout-odd")
    boxes = layout.write_layout(cloud(spark, rows), path, 12).collect()
    assert sum(r["n_points"] for r in boxes) == len(rows) and max(r["n_points"] for r in boxes) < 1_500
    assert layout.scan_box(spark, path, Bounds(0.0, 0.0, 10.0, 10.0)).count() == len(rows) - 3
    assert layout.layout_bounds(spark, path).first()["max_x"] <= 10
    none = stage_path(spark, "layout-none")
    layout.write_layout(cloud(spark, []), none, 3)
    assert layout.layout_bounds(spark, none).first()["n_points"] == 0 and layout.scan_box(spark, none, Bounds(0, 0, 1, 1)).count() == 0


def test_scan_names_the_file_of_each_row(spark, sf):
    path = stage_path(spark, "scan-file")
    layout.write_layout(lineitem_points(spark, sf), path, 3)
    got = scan_points(spark, f"{path}/points", ground_only=False, columns=("x", "file")).select("file").distinct().collect()
    assert {r["file"] for r in got} == {r["file"] for r in layout.layout_boxes(spark, path).collect()}


@pytest.mark.parametrize("most", [0, 500_000])
def test_infinite_places_meet_nobody(spark, most):
    rng = random.Random(2)
    t = [(i, rng.random() * 50, rng.random() * 50, rng.random()) for i in range(200)]
    odd = [(900, float("inf"), 1.0, 1.0), (901, 1.0, float("-inf"), 1.0), (902, float("nan"), 1.0, 1.0), (903, 1.0, 1.0, None)]
    s = [(i, rng.random() * 50, rng.random() * 50, rng.random()) for i in range(150)]
    with point_index.held_at_most(most):
        got = {r["source_id"]: r["n"] for r in neighbors.counts_within(cloud(spark, s + odd), cloud(spark, t + odd), 4.0).collect()}
        near = {r["source_id"]: r["target_id"] for r in neighbors.nearest_within(cloud(spark, s + odd), cloud(spark, t + odd), 4.0).collect()}
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a[1:], b[1:], strict=True))
    assert got == {a[0]: n for a in s if (n := sum(d2(a, b) <= 16 for b in t))}
    assert near == {a[0]: min((d2(a, b), b[0]) for b in t)[1] for a in s if a[0] in got}


def test_large_clouds_meet_in_a_join(spark, sf):
    from stratamesh.plans import registry

    plan = registry.QUERIES["c2c_nn_by_bucket"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "MapInArrow" not in plan
    assert point_index.MOST == 500_000


def test_core_points_are_not_sorted_in_one_task(spark, sf):
    pts = lineitem_points(spark, sf)
    got = sampling.core_points(pts, 10.0, seed=3)
    assert "TakeOrdered" not in got._jdf.queryExecution().executedPlan().toString()
    n = pts.count()
    assert sorted(r["point_id"] for r in got.collect()) == sorted(r["point_id"] for r in sampling.sample(pts, n // 10, seed=3).collect())
    assert sampling.core_points(pts, 0.0).count() == max(1, n // 1000) and got.columns == pts.columns
