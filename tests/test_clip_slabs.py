"""Outlines of many edges: the table of slabs against the fold over all edges."""

import math
import random
import time

import numpy as np
import pytest

from stratamesh.operators import clip as clips
from stratamesh.operators.clip import ClipArea, EdgeSlabs, clip, clip_statistics
from stratamesh.sources.points import lineitem_points


def star(n, cx, cy, least, most, seed):
    rng = random.Random(seed)
    return [(cx + r * math.cos(a), cy + r * math.sin(a)) for i in range(n) if (a := 2 * math.pi * i / n) is not None and (r := rng.uniform(least, most))]


def plain(rows, area):
    """Ids inside, edge by edge over all points."""
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    inside = np.zeros(len(rows), bool)
    for poly in area.polygons:
        odd = np.zeros(len(rows), bool)
        for r in poly:
            for (x1, y1), (x2, y2) in zip(r, r[1:] + r[:1], strict=True):
                if y1 != y2:
                    odd ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) / (y2 - y1) * (y - y1) + x1)
        inside |= odd
    return sorted(r[0] for r, i in zip(rows, inside, strict=True) if i)


AREAS = {
    "star with a hole": ClipArea.of([star(900, 50, 50, 20, 45, 1), star(300, 50, 50, 3, 9, 2)]),
    "polygons that overlap": ClipArea.of([star(700, 40, 40, 10, 35, 3)], [star(700, 60, 60, 10, 35, 4)]),
    "comb": ClipArea.of([[(i / 10, 90.0 if i % 2 else 10.0) for i in range(1000)] + [(100.0, 5.0), (0.0, 5.0)]]),
    "sides on whole numbers": ClipArea.of([[(10.0 + i % 2, float(i) / 8) for i in range(400)] + [(60.0 + i % 3, float(i) / 8) for i in reversed(range(400))]]),
}


@pytest.mark.parametrize("name", AREAS)
@pytest.mark.parametrize("copies", [0, 1_000_000])
def test_slabs_equal_the_fold(spark, monkeypatch, name, copies):
    monkeypatch.setattr(clips, "BROADCAST_COPIES", copies)
    area, rng = AREAS[name], random.Random(5)
    rows = [(i, rng.random() * 110 - 5, rng.random() * 110 - 5) for i in range(3_000)]
    rows += [(10_000 + i, float(x), y / 8) for i, (x, y) in enumerate((x, y) for x in (10, 11, 60, 61, 62) for y in range(-1, 402))]  # on vertices and sides
    rows += [(20_000 + i, *p) for i, p in enumerate(area.polygons[0][0])]
    odd = [(-1, None, 50.0), (-2, 50.0, None), (-3, float("nan"), 50.0), (-4, 50.0, float("nan")), (-5, float("-inf"), 50.0), (-6, 50.0, float("inf"))]
    want = plain(rows, area)
    pts = spark.createDataFrame([(*r, r[0]) for r in rows + rows[:5] + odd], "point_id long, x double, y double, slab long")
    assert area.n_edges > clips.SLAB_EDGES
    got = clip(pts, area)
    assert got.columns == pts.columns
    assert sorted(r["point_id"] for r in got.collect()) == sorted(want + [i for i in want if i in range(5)])
    s = clip_statistics(pts, area).first()
    assert (s["total"], s["inside"]) == (len(rows) + 11, len(want) + sum(i in range(5) for i in want))
    assert clip(pts.limit(0), area).count() == 0


def test_slabs_grow_with_the_outline_and_hold_what_passes():
    for area in AREAS.values():
        index = EdgeSlabs.of(area)
        assert len(index.slab) <= max(clips.SLAB_COPIES * area.n_edges, area.n_edges)
        assert (np.diff(index.slab) >= 0).all() and index.slab.max() < len(index.bounds) - 1
    long = star(100_000, 0, 0, 400, 401, 6)
    index, y = EdgeSlabs.of(ClipArea.of([long])), np.array([p[1] for p in long])
    low, high = np.minimum(y, np.roll(y, -1)), np.maximum(y, np.roll(y, -1))
    middle = (index.bounds[1:] + index.bounds[:-1]) / 2
    passing = np.array([((low <= m) & (high > m)).sum() for m in middle[::50]])
    assert (np.bincount(index.slab)[::50] <= passing + 4 * clips.SLAB_VERTICES).all()  # what passes by, and those that begin or end here


def test_a_hundred_thousand_edges(spark, sf):
    area = ClipArea.of([star(100_000, 500, 500, 380, 381, 7)])
    pts = lineitem_points(spark, sf.replace("sf0.001", "sf0.1"))
    began = time.time()
    n = clip(pts, area).count()
    took = time.time() - began
    near = pts.selectExpr("pow(x - 500, 2) + pow(y - 500, 2) AS d").selectExpr("count_if(d < 379.9 * 379.9) AS low", "count_if(d <= 381 * 381) AS high").first()
    assert near["low"] <= n <= near["high"] and took < 40
    plan = clip(pts, area)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and len(plan) < 2_000_000
