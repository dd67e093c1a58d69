"""Neighbours found tile by tile, against all pairs: copies, crowded tiles dealt over parts, few targets sent."""

import io
from contextlib import redirect_stdout

import numpy as np
import pytest

from stratamesh.operators import around, neighbors, point_index


def cloud(spark, xyz, first=0):
    return spark.createDataFrame([(first + i, *map(float, r)) for i, r in enumerate(xyz)], "point_id long, x double, y double, z double")


@pytest.fixture(scope="module")
def both():
    rng = np.random.default_rng(5)
    s, t = (np.round(rng.uniform(-20, 20, (300, 3)) * (1, 1, 0.2), 1) for _ in range(2))
    t[200:] = [0.5, -0.5, 0.0] + np.round(rng.uniform(0, 1, (100, 3)), 1)  # a crowded place
    return np.concatenate([s, s[:60], t[:5]]), np.concatenate([t, t[:150], t[:150]])


@pytest.mark.parametrize("most, rows", [(10**6, 10**5), (500, 10**5), (0, 10**5), (0, 40)])
def test_against_all_pairs(spark, both, monkeypatch, most, rows):
    monkeypatch.setattr(around, "ROWS", rows)
    s, t = both
    reach = 4.0
    r = t[None] - s[:, None]
    d2 = r[..., 0] ** 2 + r[..., 1] ** 2 + r[..., 2] ** 2
    near = d2 <= reach * reach
    with point_index.held_at_most(most):
        a, b = cloud(spark, s), cloud(spark, t, 1000)
        counts = {r["source_id"]: r["n"] for r in neighbors.counts_within(a, b, reach).collect()}
        first = {r["source_id"]: r["target_id"] for r in neighbors.nearest_within(a, b, reach).collect()}
        moments = {r["source_id"]: r for r in neighbors.moments_within(a, b, reach, nearest=True).collect()}
        five = neighbors.knn(a, b, 5, start=2.0).collect()
    own = {i: int(n) for i, n in enumerate(near.sum(1)) if n}
    assert counts == own
    order = np.lexsort((np.broadcast_to(np.arange(len(t)), d2.shape), d2))
    assert first == {i: 1000 + int(order[i, 0]) for i in own}
    assert {(r["source_id"], r["rank"]): r["target_id"] for r in five} == {(i, k + 1): 1000 + int(order[i, k]) for i in range(len(s)) for k in range(5)}
    for i in own:
        rel, got = r[i][near[i]], moments[i]
        assert got["n"] == own[i] and got["target_id"] == first[i]
        assert np.allclose([got[f"m{c}"] for c in "xyz"], rel.mean(0))
        cov = np.cov(rel.T, bias=True).reshape(3, 3)
        assert np.allclose([got[c] for c in ("xx", "xy", "xz", "yy", "yz", "zz")], cov[np.triu_indices(3)], atol=1e-9)


def test_no_pair_is_sorted(spark, both):
    """Large sides: the least of a struct was an aggregate by sorting, over all pairs of a join."""
    with point_index.held_at_most(0):
        got = neighbors.nearest_within(cloud(spark, both[0]), cloud(spark, both[1], 1000), 4.0)
    with redirect_stdout(io.StringIO()) as plan:
        got.explain()
    assert "SortAggregate" not in plan.getvalue()


def test_quadtree_asks_once_a_place(spark, both):
    s, t = both
    s = np.concatenate([s] * 3)
    d2 = ((t[None] - s[:, None]) ** 2).sum(-1)
    order = np.lexsort((np.broadcast_to(np.arange(len(t)), d2.shape), np.round(d2, 9)))
    with point_index.held_at_most(0):
        got = neighbors.knn(cloud(spark, s), cloud(spark, t, 1000), 4)
        assert {(r["source_id"], r["rank"]): round(r["distance"], 6) for r in got.collect()} == {(i, k + 1): round(float(np.sqrt(d2[i, order[i, k]])), 6) for i in range(len(s)) for k in range(4)}
    with redirect_stdout(io.StringIO()) as plan:
        got.explain()
    assert "place" in plan.getvalue()


def test_icp_of_a_denser_cloud(spark):
    """Eight iterations were enough for the smallest tables only."""
    from stratamesh.plans import registry

    got = registry.QUERIES["icp_align"](spark, "/root/testdata/sf0.1").orderBy("row").collect()
    want = np.round(registry._BACK, 5)
    assert all(r["rmse"] == 0.0 and np.allclose([r[f"c{j}"] for j in range(4)], want[r["row"]], atol=1e-9) for r in got)


def test_las_files_are_small_enough_to_be_held():
    import inspect

    from stratamesh.sources import las

    assert inspect.signature(las.write).parameters["per_file"].default * 30 <= 32 << 20


def shuffled_rows(spark):
    """Rows that all stages of the session have shuffled so far."""
    store, sc = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext
    stages = store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("packed", [1_000, 7])
def test_radius_pairs_of_copies(spark, monkeypatch, packed):
    """Every row was spread over nine buckets and compared with every row; now places are."""
    from stratamesh.operators.estimator import NearestNeighbors

    monkeypatch.setattr(neighbors, "PACKED", packed)
    rng = np.random.default_rng(8)
    s, t = (np.repeat(np.round(rng.uniform(-6, 6, (12, 3)), 1), 60, 0) for _ in range(2))
    s[-60:] = s[0]  # a place of 120 rows
    t[:60] = t[60] + [3.0, 0.0, 0.0]  # the reach is included
    s = np.concatenate([s, t[60:61]])
    d2 = ((t[None] - s[:, None]) ** 2).sum(-1)
    with point_index.held_at_most(0):
        own = cloud(spark, s).unionByName(spark.createDataFrame([(None, *map(float, s[0]))] * 2 + [(-1, 0.0, float("nan"), 0.0), (-2, None, 0.0, 0.0)], "point_id long, x double, y double, z double"))
        before = shuffled_rows(spark)
        got = [(r["source_id"], r["target_id"], r["distance"]) for r in NearestNeighbors(radius=3.0).fit(cloud(spark, t, 1000)).radius_neighbors(own, digits=6).collect()]
    want = [(int(i), 1000 + int(j), round(float(np.sqrt(d2[i, j])), 6)) for i, j in zip(*np.nonzero(d2 <= 9.0 + 1e-12), strict=True)]
    want += [(None, j, d) for i, j, d in want if i == 0 for _ in range(2)]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=order) == sorted(want, key=order)
    if packed == 1_000:
        assert shuffled_rows(spark) - before < len(s)
