"""Sums over all targets in a region around each query, without a list of pairs.

Targets are halved into a tree whose parts know their sums; queries meet them in groups of neighbours. A part that lies in the region of
every query of a group is added as a whole, one at the edge is compared as a matrix of queries and targets, whose zeros and ones then multiply the
targets' columns. Pairs so near the edge that rounding decides are tested one by one, so the result is that of testing every pair.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from stratamesh.operators.point_index import Tree

#: Sums of a target's weight, places and products of places, relative to some place.
COLUMNS = ("n", "mx", "my", "mz", "xx", "xy", "xz", "yy", "yz", "zz")
_PRODUCTS = ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))
#: Targets to a part of the tree; queries to a group, at least and at most; the power of 2 of groups that go down the tree together, at most; targets that are compared with a group at once;
#: how wide groups that go together may be, in reaches (sums are relative to their middle).
_PART, _GROUP, _GROUPS, _AT_ONCE, _WIDE = 16, (32, 48), 6, 2048, 16
#: What rounding makes of a squared distance, in units of the largest square it is made of, at most.
_ROUNDING = 256 * np.finfo(float).eps


@dataclass(frozen=True)
class Region:
    """A ball of the radius; with a depth, a cylinder along z, or along the queries' own directions (their columns 3 to 5), up to depth on either side."""

    radius: float
    depth: float | None = None
    along: bool = False

    @property
    def reach(self) -> float:
        return math.hypot(self.radius, self.depth) if self.along else self.radius

    def _squares(self, d: np.ndarray) -> np.ndarray:
        flat = self.depth is not None and not self.along
        return d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + (0.0 if flat else d[:, 2] * d[:, 2])

    def misses(self, gap: np.ndarray) -> np.ndarray:
        """Whether boxes so far apart have no pair in the region."""
        out = self._squares(gap) > self.reach**2 * (1 + 1e-12)
        return out if self.depth is None or self.along else out | (gap[:, 2] > self.depth * (1 + 1e-12))

    def holds(self, span: np.ndarray) -> np.ndarray:
        """Whether all pairs of boxes that span so much are in the region."""
        if self.along:  # whatever the direction
            return self._squares(span) < min(self.radius, self.depth) ** 2 * (1 - 1e-9)
        out = self._squares(span) < self.radius**2 * (1 - 1e-12)
        return out if self.depth is None else out & (span[:, 2] < self.depth * (1 - 1e-12))

    def has(self, q: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Whether t is in the region of q, row by row."""
        d = t - q[:, :3]
        d2 = self._squares(d)
        if self.along:
            at = d[:, 0] * q[:, 3] + d[:, 1] * q[:, 4] + d[:, 2] * q[:, 5]
            return (np.abs(at) <= self.depth) & (d2 - at * at <= self.radius**2) & (d2 <= self.reach**2)
        near = d2 <= self.radius * self.radius
        return near if self.depth is None else near & (np.abs(d[:, 2]) <= self.depth)

    def met(self, q: np.ndarray, height: np.ndarray, size: int) -> Callable[[np.ndarray, np.ndarray, float], tuple[np.ndarray, np.ndarray]]:
        """A function from rows of _places(), their heights and a slack to two matrices of targets and queries: where a target is in the region of a query, surely and maybe.

        q is relative to the place that the rows are relative to, heights aren't. At most `size` rows at once.
        """
        x, y, z = q[:, :3].T
        own, flat = _places(q, self), self.depth is not None and not self.along
        first = np.stack([-2 * x, -2 * y, 0 * z if flat else -2 * z, np.ones(len(q)), own[:, 3] - self.radius**2])
        out, more = np.empty((size, len(q))), None if self.depth is None else np.empty((size, len(q)))
        if self.along:
            a, b, c = q[:, 3:6].T
            second = np.stack([a, b, c, 0 * x, -(x * a + y * b + z * c)])

        def run(t: np.ndarray, high: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
            excess = np.matmul(t, first, out=out[: len(t)])
            if self.along:
                at = np.matmul(t, second, out=more[: len(t)])
                at *= at
                excess -= at
                at -= self.depth**2
                np.maximum(excess, at, out=excess)
            inside, maybe = excess <= -slack, excess <= slack
            if flat:
                at = np.subtract(high[:, None], height, out=more[: len(t)])
                level = np.abs(at, out=at) <= self.depth
                inside &= level
                maybe &= level
            return inside, maybe

        return run


def moved(sums: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Sums (rows of COLUMNS) relative to a place, relative to one that lies `by` from it."""
    n, m = sums[:, :1], sums[:, 1:4]
    return np.column_stack([n, m - n * by, *(sums[:, 4 + i] - m[:, a] * by[:, b] - m[:, b] * by[:, a] + n[:, 0] * by[:, a] * by[:, b] for i, (a, b) in enumerate(_PRODUCTS))])


def _places(t: np.ndarray, region: Region) -> np.ndarray:
    """x, y, z, the square of the part of them that the region's radius is about, and 1."""
    return np.column_stack([t[:, :3], region._squares(t), np.ones(len(t))])


def _terms(t: np.ndarray, n: np.ndarray, columns: tuple[int, ...]) -> np.ndarray:
    """The columns of COLUMNS for targets relative to a place, with weights."""
    product = lambda c: n * t[:, _PRODUCTS[c - 4][0]] * t[:, _PRODUCTS[c - 4][1]]
    return np.column_stack([n if c == 0 else n * t[:, c - 1] if c < 4 else product(c) for c in columns])


class SumTree:
    """A tree of targets with weights, and the sums of its parts, each relative to the middle of its box."""

    def __init__(self, xyz: np.ndarray, n: np.ndarray):
        self.tree = tree = Tree(xyz, _PART)
        self.xyz, self.n = tree.xyz, n[tree.point]
        self.middle = [(low + high) / 2 for low, high in tree.boxes]
        start = tree.start[-1]
        own = _terms(self.xyz - np.repeat(self.middle[-1], np.diff(start), 0), self.n, tuple(range(10)))
        sums = [np.add.reduceat(own, start[:-1])]
        for level in range(len(tree.start) - 2, -1, -1):
            up = moved(sums[-1], np.repeat(self.middle[level], 2, 0) - self.middle[level + 1])
            sums.append(up[::2] + up[1::2])
        self.sums = sums[::-1]

    def around(self, q: np.ndarray, region: Region, columns: tuple[int, ...] = tuple(range(10))) -> np.ndarray:
        """COLUMNS of the targets in each query's region, relative to the query. Only the numbered columns are right: a mean's needs n, a product's both means too."""
        total = np.zeros((len(q), 10))
        if not len(q):
            return total
        groups = Tree(q[:, :3], self._group(q, region))
        own, start, levels = q[groups.point], groups.start[-1], len(groups.start) - 1
        wide = next((i for i, (low, high) in enumerate(groups.boxes) if (high - low).max() <= _WIDE * region.reach), levels)
        level = max(wide, levels - _GROUPS)  # parts of this level go down the tree together
        low, high = groups.boxes[-1]
        each = 1 << levels - level
        for some in range(0, 1 << levels, each):
            of = slice(some, some + each)
            centre = (low[of].min(0) + high[of].max(0)) / 2
            whole, group, part = self._met(low[of], high[of], centre, region)
            ends = np.searchsorted(group, np.arange(each + 1))
            there, part = np.unique(part, return_inverse=True)
            near = self._near(there, centre, region, columns)
            for g in range(each):
                lo, hi = start[some + g], start[some + g + 1]
                at = own[lo:hi].copy()
                at[:, :3] -= centre
                sums = np.tile(whole[g], (hi - lo, 1))
                if ends[g] < ends[g + 1]:
                    sums[:, columns] += self._edge(own[lo:hi], at, part[ends[g] : ends[g + 1]], *near, region)
                total[groups.point[lo:hi]] = moved(sums, at[:, :3])
        return total

    def _group(self, q: np.ndarray, region: Region) -> int:
        """How many queries lie in a cube of half the reach, about."""
        size = np.maximum(q[:, :3].max(0) - q[:, :3].min(0), region.reach / 2)
        return int(np.clip(len(q) * np.prod(region.reach / 2 / size), *_GROUP))

    def _met(self, low: np.ndarray, high: np.ndarray, centre: np.ndarray, region: Region) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sums of the parts that boxes of queries have as a whole, relative to the centre; box and part of the lowest level that need a closer look, by box)."""
        whole, group, part = np.zeros((len(low), 10)), np.arange(len(low)), np.zeros(len(low), np.int64)
        for level, (below, above) in enumerate(self.tree.boxes):
            if level:
                group, part = np.repeat(group, 2), np.repeat(2 * part, 2) + np.tile([0, 1], len(part))
            a, b, c, d = below[part], above[part], low[group], high[group]
            met = ~region.misses(np.maximum(np.maximum(a - d, c - b), 0.0))
            held = region.holds(np.maximum(b - c, d - a))
            if held.any():
                g, p = group[held], part[held]
                first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
                whole[g[first]] += np.add.reduceat(moved(self.sums[level][p], centre - self.middle[level][p]), first)
            left = met & ~held
            group, part = group[left], part[left]
        return whole, group, part

    def _near(self, part: np.ndarray, centre: np.ndarray, region: Region, columns: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers, _places(), _terms()) of the targets of these parts relative to the centre, part by part: all as long as the longest, the rest has no weight."""
        first, end = self.tree.start[-1][part], self.tree.start[-1][part + 1]
        points = first[:, None] + np.arange((end - first).max(initial=1))
        there = points < end[:, None]
        points = np.where(there, points, 0)
        t = (self.xyz[points] - centre).reshape(-1, 3)
        return points, _places(t, region).reshape(*points.shape, 5), _terms(t, np.where(there, self.n[points], 0.0).ravel(), columns).reshape(*points.shape, len(columns))

    def _edge(self, q: np.ndarray, at: np.ndarray, part: np.ndarray, points: np.ndarray, places: np.ndarray, terms: np.ndarray, region: Region) -> np.ndarray:
        """The sums of the terms of those targets of the parts that are in each query's region. at: q relative to the centre, as places and terms are."""
        step = max(1, _AT_ONCE // points.shape[1])
        own, size = _places(at, region)[:, 3].max(), step * points.shape[1]
        met, weight, total = region.met(at, q[:, 2], size), np.empty((size, len(q))), np.zeros((len(q), terms.shape[2]))
        for i in range(0, len(part), step):
            some = part[i : i + step]
            t, rows = places[some].reshape(-1, places.shape[2]), points[some].ravel()
            inside, maybe = met(t, self.xyz[rows, 2], _ROUNDING * (t[:, 3].max() + own + region.reach**2))
            if np.count_nonzero(inside) != np.count_nonzero(maybe):
                j, k = np.nonzero(maybe & ~inside)
                inside[j, k] = region.has(q[k], self.xyz[rows[j]])
            w = weight[: len(t)]
            np.copyto(w, inside)
            total += w.T @ terms[some].reshape(len(t), -1)
        return total
