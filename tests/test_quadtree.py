import math

import numpy as np
import pytest

from stratamesh.operators import neighbors, quadtree


def cloud(spark, points, ids=None, kind="long"):
    rows = [(i, *(None if v is None else float(v) for v in p)) for i, p in zip(ids or range(len(points)), points, strict=True)]
    return spark.createDataFrame(rows, f"point_id {kind}, x double, y double, z double")


def searched(spark, s, t, k, reach=math.inf, **sizes):
    got = quadtree.nearest(neighbors.sources(cloud(spark, s)), neighbors.targets(cloud(spark, t)), k, reach, **sizes).collect()
    return {(r["source_id"], r["rank"]): (r["d2"], r["target_id"]) for r in got}


def wanted(s, t, k, reach=math.inf):
    d = s[:, None, :] - t[None, :, :]
    d2 = d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2]
    order = np.argsort(d2, 1, kind="stable")[:, :k]  # ties to the least id
    return {(i, r + 1): (d2[i, j], j) for i in range(len(s)) for r, j in enumerate(order[i]) if d2[i, j] <= reach * reach}


def uneven(n, seed):
    """Half of the points in a place of a ten-thousandth of the side, some of them at one point, the others spread."""
    rng = np.random.default_rng(seed)
    hot = [500, 500, 0] + rng.uniform(0, 0.1, (n // 2, 3))
    hot[: n // 8] = hot[0]
    return np.r_[hot, rng.uniform(0, 1000, (n - n // 2, 3)) * [1, 1, 0.01]]


@pytest.mark.parametrize(("k", "reach", "group"), [(1, math.inf, 1000), (5, math.inf, 13), (3, 20.0, 40)])
def test_nearest_equals_brute_force(spark, k, reach, group):
    lonely = [[-5e4, 3e5, 10.0], [1e6, 1e6, 0.0]]
    s, t = np.r_[uneven(160, 1), lonely], uneven(400, 2)
    t[-30:] = np.r_[s[:20], s[100:110]]  # distances of nothing, and ties
    assert searched(spark, s, t, k, reach, leaf=16, group=group) == wanted(s, t, k, reach)


def test_fewer_targets_than_asked_for_and_odd_rows(spark):
    s, t = uneven(20, 3), uneven(4, 4)
    assert searched(spark, s, t, 9, leaf=1, group=2) == wanted(s, t, 9)
    assert searched(spark, s, t, 2, 1e-9, leaf=1, group=2) == {}
    odd = [(math.inf, 1, 1), (1, math.nan, 1), (1, 1, None), (None, 1, 1)]
    assert searched(spark, [*s, *odd], [*odd, *t], 2) == {q: (d, i + 4) for q, (d, i) in wanted(s, t, 2).items()}
    assert searched(spark, odd, t, 2) == {}
    with pytest.raises(ValueError, match="empty"):
        searched(spark, s, odd, 2)


def test_ids_of_text(spark):
    s, t = uneven(10, 5), np.repeat(uneven(10, 6), 2, 0)
    names = [f"p{(7 * i) % 20:02d}" for i in range(20)]
    got = quadtree.nearest(neighbors.sources(cloud(spark, s)), neighbors.targets(cloud(spark, t, names, "string")), 1, leaf=4).collect()
    want = wanted(s, t, 1)
    assert {r["source_id"]: r["target_id"] for r in got} == {i: min(names[j // 2 * 2], names[j // 2 * 2 + 1]) for (i, _), (_, j) in want.items()}


def test_tree_divides_crowded_places_only(spark):
    t = uneven(4000, 7)
    tree, _ = quadtree.tree_of(neighbors.targets(cloud(spark, t)), 50)
    n = tree.n[tree.leaves]
    assert n.sum() == 4000 and tree.n[0] == 4000
    assert sorted(n)[-1] == 500 and sorted(n)[-2] <= 50  # 500 points are at one place, which nothing can divide
    hot = (tree.low[tree.leaves, :2] >= 499.9).all(1) & (tree.high[tree.leaves, :2] <= 500.2).all(1)
    assert n[hot].sum() >= 2000 and hot.sum() >= 30 and (~hot).sum() < 300


def test_most_sources_look_at_few_leaves(spark):
    t = uneven(20_000, 8)
    tree, _ = quadtree.tree_of(neighbors.targets(cloud(spark, t)), 500)
    k, s = 4, uneven(2000, 9)[1000:]
    d = np.sort(((s[:, None, :2] - t[None, :, :2]) ** 2).sum(2), 1)[:, k - 1]
    d3 = np.array([np.sort(((q - t) ** 2).sum(1))[k - 1] for q in s])
    query, _, bound = tree.first_leaf(s, k, math.inf)
    assert (query == np.arange(1000)).all() and (bound >= d3).all() and (d <= d3).all()
    assert len(tree.leaves_within(s, d3)[0]) < 2.5 * len(s)
