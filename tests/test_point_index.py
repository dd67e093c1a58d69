"""The nearest points of an index: what is tested for a query doesn't grow with crowded places or with points above and below: F18 to F21, F25, F26."""

import math

import numpy as np
import pytest

from stratamesh.operators import point_index


def clusters(rng, n, each):
    return np.repeat(rng.uniform(0, 1, (n // each, 3)) * (64, 64, 60), each, 0) + rng.uniform(-0.5, 0.5, (n, 3)) * (1, 0, 1)


@pytest.mark.parametrize("each", [60, 360])
def test_few_points_are_tested_for_a_query(monkeypatch, each):
    rng, tested = np.random.default_rng(1), []
    t, s = clusters(rng, 7200, each), clusters(rng, 720, each)
    block = point_index.PointIndex._block
    monkeypatch.setattr(point_index.PointIndex, "_block", lambda *a: tested.append(len((got := block(*a))[1])) or got)
    if tree := getattr(point_index, "Tree", None):
        inside = tree._inside
        monkeypatch.setattr(tree, "_inside", lambda *a: tested.append((got := inside(*a))[0].size) or got)
    query, rank, point, d2 = point_index.PointIndex(np.arange(len(t)), t).nearest(s, 1, 8.0)
    want = ((t[None] - s[:, None]) ** 2).sum(-1).min(1)
    near = want <= 64.0
    assert sorted(query) == list(np.flatnonzero(near)) and np.allclose(d2[np.argsort(query)], want[near])
    assert sum(tested) < 300 * len(s), sum(tested) / len(s)


@pytest.mark.parametrize("n, k, reach", [(1, 3, math.inf), (17, 1, math.inf), (17, 20, math.inf), (500, 5, 3.0), (500, 40, math.inf), (500, 5, math.inf)])
def test_nearest_of_all(n, k, reach):
    """Whole coordinates: many points at one place and many ties, which go to the least id; far queries too."""
    rng = np.random.default_rng(n + k)
    t, s = np.floor(rng.uniform(0, 6, (n, 3))), np.concatenate([np.floor(rng.uniform(-2, 8, (60, 3))), [[1e6, 0.0, 0.0]]])
    ids = rng.permutation(n)
    index = point_index.PointIndex(ids, t)
    query, rank, point, d2 = index.nearest(s, k, reach)
    own = ((t[None] - s[:, None]) ** 2).sum(-1)
    want = [(i, r + 1, ids[j], own[i, j]) for i in range(len(s)) for r, j in enumerate(np.lexsort((ids, own[i]))[:k]) if own[i, j] <= reach * reach]
    assert sorted(zip(query, rank, index.ids[point], d2, strict=True)) == want
