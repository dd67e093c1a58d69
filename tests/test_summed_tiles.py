"""Queries over sums of neighbours: sources or targets copied to tiles, whichever are fewer, and tiles dealt over parts; the same answers. Before, a core was compared with every point near it."""

import numpy as np
import pytest

from stratamesh.operators import around, cylinder, neighbors, point_index
from stratamesh.operators.range_sums import Region


def cloud(spark, xyz, first=0):
    return spark.createDataFrame([(first + i, *map(float, r)) for i, r in enumerate(xyz)], "point_id long, x double, y double, z double")


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(8)
    return [np.column_stack([np.round(rng.uniform(0, 30, n), 2), rng.integers(0, 300, n) * 0.1, rng.integers(0, 40, n) * 0.1]) for n in (60, 900, 700)]


@pytest.mark.parametrize("rows", [10**5, 30])
@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize("upright", [True, False])
def test_cylinders(spark, points, monkeypatch, rows, few, upright):
    """F2 m3c2_full, F4 m3c2_stats, F5 m3c2_upright, F6 m3c2_upright_by_bucket, F8 m3c2_tiles."""
    monkeypatch.setattr(around, "ROWS", rows)
    cores, *both = points if few else (points[1], *points[:2])
    turn = np.tile([0.0, 0.6, 0.8], (len(cores), 1))
    with point_index.held_at_most(0):
        oriented = neighbors.sources(cloud(spark, cores))
        for c, v in zip(("nx", "ny", "nz"), turn[0], strict=True):
            oriented = oriented.selectExpr("*", f"{v}D AS {c}")
        got = cylinder.cylinder_statistics(oriented, *(cloud(spark, t) for t in both), cylinder.CylinderParams(2.0, 2.0, 2.0), upright).collect()
    region, q, seen = Region(2.0, 2.0, not upright), np.column_stack([cores, turn]), 0
    of = {r["source_id"]: r for r in got}
    assert len(of) == len(got)
    for i in range(len(cores)):
        for side, t in enumerate(both, 1):
            near = t[region.has(np.repeat(q[i : i + 1], len(t), 0), t)] - cores[i]
            along = near[:, 2] if upright else near @ turn[0]
            n = of[i][f"n{side}"] if i in of else 0
            assert n == len(near)
            seen += n
            if n:
                assert abs(of[i][f"mean{side}"] - along.mean()) < 1e-9
            if n > 1:
                assert abs(of[i][f"var{side}"] - along.var(ddof=1)) < 1e-9
    assert seen


@pytest.mark.parametrize("few", [True, False])
def test_moments_and_counts(spark, points, few):
    """F7 normals, F9 and F12 vertical_plane_radius, F11 neighbour_moments, F13 and F14 radius_count."""
    s, t = points[:2] if few else points[1::-1]
    d = t[None] - s[:, None]
    near = (d**2).sum(2) <= 9.0
    with point_index.held_at_most(0):
        a, b = cloud(spark, s), cloud(spark, t, 1000)
        counts = {r["source_id"]: r["n"] for r in neighbors.counts_within(a, b, 3.0).collect()}
        plain, with_nearest = ({r["source_id"]: r for r in neighbors.moments_within(a, b, 3.0, nearest=x).collect()} for x in (False, True))
    assert counts == {i: n for i, n in enumerate(near.sum(1)) if n} and set(plain) == set(with_nearest) == set(counts)
    for i, r in plain.items():
        own = d[i][near[i]]
        assert np.allclose([r["mx"], r["my"], r["mz"]], own.mean(0)) and np.allclose([r["xx"], r["yz"]], [own[:, 0].var(), np.cov(own[:, 1], own[:, 2], bias=True)[0, 1]])
        assert with_nearest[i]["target_id"] == 1000 + min((v, j) for j, v in enumerate((d[i] ** 2).sum(1)) if near[i, j])[1]


def test_fewer_sources_are_copied(spark, points):
    """Before, every target of two large clouds went to all tiles in reach."""
    s, t = neighbors.sources(cloud(spark, points[0][:20])), neighbors.targets(cloud(spark, points[1]))
    with point_index.held_at_most(0):
        for added in (True, False):
            got, split = around.fold(s, t, 3.0, around.counts_of(3.0), "n long", added=added)
            assert split == added  # sources are asked in several tiles, so sums are to be added up
            plan = got._jdf.queryExecution().optimizedPlan().toString()
            explodes = [line for line in plan.splitlines() if "Generate explode" in line and ("sx" in line or "tx" in line)]
            assert explodes and all(("sx" in line) == added for line in explodes)
