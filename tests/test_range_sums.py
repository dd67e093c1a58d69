"""Sums in regions without pairs, against all pairs; and that little is tested for them."""

import numpy as np
import pytest

from stratamesh.operators import range_sums
from stratamesh.operators.range_sums import Region, SumTree, _terms


@pytest.fixture(scope="module")
def cloud():
    """Places on a lattice, so that many pairs lie right on an edge, with weights."""
    rng = np.random.default_rng(3)
    t = np.column_stack([rng.integers(0, 200, 6000) * 1.0, rng.integers(0, 400, 6000) * 0.4, rng.integers(1, 61, 6000) * 1.0])
    t[3000:, 0] += np.round(rng.uniform(0, 1, 3000), 4)
    q = np.column_stack([rng.integers(-20, 220, 300) * 1.0, rng.integers(0, 400, 300) * 0.4, rng.integers(1, 61, 300) * 1.0])
    turn = rng.normal(size=(300, 3))
    turn[:90], turn[90:140] = [0, 0, 1], [1, 0, 0]
    return t, rng.integers(1, 4, 6000).astype(float), np.column_stack([q, turn / np.linalg.norm(turn, axis=1)[:, None]])


@pytest.mark.parametrize("region", [Region(25.0), Region(20.0, 20.0), Region(20.0, 20.0, True), Region(70.0), Region(2.0), Region(0.5)])
@pytest.mark.parametrize("move", [0.0, 6e6])
def test_against_all_pairs(cloud, region, move):
    t, n, q = cloud
    t, q = t + [move, move, 0], q + [move, move, 0, 0, 0, 0]
    got = SumTree(t, n).around(q, region)
    for i in range(len(q)):
        near = region.has(np.repeat(q[i : i + 1], len(t), 0), t)
        assert got[i, 0] == n[near].sum()
        assert np.allclose(got[i], _terms(t[near] - q[i, :3], n[near], tuple(range(10))).sum(0), rtol=0, atol=1e-9 * max(1, n[near].sum()))


def test_one_target_and_none_in_reach():
    tree = SumTree(np.array([[1.0, 2.0, 3.0]]), np.array([2.0]))
    got = tree.around(np.array([[1.0, 2.0, 2.5], [50.0, 50.0, 50.0]]), Region(1.0))
    assert got[0].tolist() == [2, 0, 0, 1, 0, 0, 0, 0, 0, 0.5] and not got[1].any() and tree.around(np.zeros((0, 3)), Region(1.0)).shape == (0, 10)


def test_parts_inside_are_not_tested(monkeypatch):
    """normals (F7): with 16 times the targets in a ball, fewer than 0.7 of the pairs that there are."""
    tested, rng = [0], np.random.default_rng(1)
    met = Region.met

    def counted(self, q, height, size):
        run = met(self, q, height, size)

        def more(t, *a):
            tested[0] += len(q) * len(t)
            return run(t, *a)

        return more

    monkeypatch.setattr(range_sums.Region, "met", counted)
    q, share = rng.uniform(0, 200, (20_000, 3)) * (1, 1, 0.05), []
    for many in (2_000, 32_000):
        tested[0] = 0
        got = SumTree(rng.uniform(0, 200, (many, 3)) * (1, 1, 0.05), np.ones(many)).around(q, Region(60.0))
        share.append(tested[0] / got[:, 0].sum())
    assert share[1] < share[0] and share[1] < 0.7, share
