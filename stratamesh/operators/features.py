"""Coarse registration by what the surroundings of points look like: histograms of angles between normals (after Rusu et al. 2009), matched both ways, and the move that most matches agree on.

Clouds are thinned to voxel means and a bounded sample in Spark; histograms, matches and trials are the driver's, on at most MOST points a side.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamesh.functions.geometry import Matrix
from stratamesh.operators.grid import voxel_means
from stratamesh.operators.point_index import PointIndex
from stratamesh.operators.sampling import sample

#: Points of either cloud, at most.
MOST = 4_000
#: Classes of each of the three angles.
_BINS = 11


def thinned(points: DataFrame, voxel: float) -> np.ndarray:
    """x, y, z of at most MOST voxel means, the same ones on every run."""
    means = voxel_means(points, voxel).withColumn("point_id", F.xxhash64("vx", "vy", "vz"))
    got = sample(means, MOST).select("x", "y", "z").toArrow()
    return np.stack([got.column(c).to_numpy() for c in "xyz"], 1)


def _pairs(xyz: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, neighbour, distance) of all neighbours up to reach other than the point itself."""
    index = PointIndex(np.arange(len(xyz)), xyz)
    a, b, d2 = (np.concatenate(x) for x in zip(*((q, index.ids[p], d) for q, p, d in index.within(xyz, reach)), strict=True))
    other = d2 > 0
    return a[other], b[other], np.sqrt(d2[other])


def _normals(xyz: np.ndarray, reach: float) -> np.ndarray:
    """Upward directions of least spread; straight up where there are fewer than three neighbours."""
    a, b, _ = _pairs(xyz, reach)
    n = np.bincount(a, minlength=len(xyz))
    off = xyz[b] - xyz[a]
    mean = np.stack([np.bincount(a, off[:, i], len(xyz)) for i in range(3)], 1) / np.maximum(n, 1)[:, None]
    spread = np.stack([[np.bincount(a, off[:, i] * off[:, j], len(xyz)) / np.maximum(n, 1) - mean[:, i] * mean[:, j] for j in range(3)] for i in range(3)]).transpose(2, 0, 1)
    v = np.linalg.eigh(spread)[1][:, :, 0]
    v = np.where(v[:, 2:] < 0, -v, v)
    return np.where((n >= 3)[:, None], v, [0.0, 0.0, 1.0])


def histograms(xyz: np.ndarray, near: float, far: float) -> np.ndarray:
    """A row for each point: shares of three angles between its normal and its neighbours' up to `far`, and the neighbours' own shares, nearer ones counting more."""
    normal = _normals(xyz, near)
    a, b, d = _pairs(xyz, far)
    line, u = (xyz[b] - xyz[a]) / d[:, None], normal[a]
    v = np.cross(line, u)
    v /= np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]
    w = np.cross(u, v)
    dot = lambda p, q: (p * q).sum(1)
    angles = (dot(v, normal[b]) / 2 + 0.5, dot(u, line) / 2 + 0.5, np.arctan2(dot(w, normal[b]), dot(u, normal[b])) / (2 * np.pi) + 0.5)
    width = 3 * _BINS
    own = np.zeros(len(xyz) * width)
    for i, share in enumerate(angles):
        own += np.bincount(a * width + i * _BINS + np.clip((share * _BINS).astype(int), 0, _BINS - 1), minlength=len(own))
    n = np.maximum(np.bincount(a, minlength=len(xyz)), 1)[:, None]
    own = own.reshape(len(xyz), width) / n
    around = np.zeros_like(own)
    np.add.at(around, a, own[b] / d[:, None])
    weight = np.maximum(np.bincount(a, 1 / d, len(xyz)), 1e-12)[:, None]
    return own + around / weight


def mutual(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs (row of a, row of b), each the other's nearest."""
    def nearest(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        size = (q * q).sum(1)
        return np.concatenate([np.argmin(size - 2 * p[i : i + 500] @ q.T, 1) for i in range(0, len(p), 500)])

    there, back = nearest(a, b), nearest(b, a)
    own = np.flatnonzero(back[there] == np.arange(len(a)))
    return np.stack([own, there[own]], 1)


def _fitted(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rotation and shift that take rows of p closest to rows of q."""
    u, _, vt = np.linalg.svd((p - p.mean(0)).T @ (q - q.mean(0)))
    r = vt.T @ np.diag([1.0, 1.0, np.sign(np.linalg.det(vt.T @ u.T)) or 1.0]) @ u.T
    return r, q.mean(0) - r @ p.mean(0)


def agreed_move(p: np.ndarray, q: np.ndarray, tolerance: float, tries: int = 4_000, seed: int = 0) -> tuple[np.ndarray, np.ndarray] | None:
    """The move of three matches (rows of p and q) that most matches agree on up to `tolerance`, fitted anew to those; None if no three fit together."""
    rng, best = np.random.default_rng(seed), np.zeros(len(p), bool)
    if len(p) < 3:
        return None
    for _ in range(tries):
        own = rng.choice(len(p), 3, replace=False)
        sides = [np.linalg.norm(x[own] - x[np.roll(own, 1)], axis=1) for x in (p, q)]
        if (np.minimum(*sides) < 0.9 * np.maximum(*sides)).any() or min(map(np.min, sides)) < 4 * tolerance:
            continue
        r, t = _fitted(p[own], q[own])
        fits = ((p @ r.T + t - q) ** 2).sum(1) < tolerance**2
        if fits.sum() > best.sum():
            best = fits
    return _fitted(p[best], q[best]) if best.sum() >= 3 else None


def feature_transform(source: DataFrame, target: DataFrame, voxel: float = 2.0) -> Matrix | None:
    """The move of the source onto the target; None where features don't tell one."""
    a, b = thinned(source, voxel), thinned(target, voxel)
    if min(len(a), len(b)) < 4:
        return None
    pairs = mutual(*(histograms(x, 2 * voxel, 5 * voxel) for x in (a, b)))
    move = agreed_move(a[pairs[:, 0]], b[pairs[:, 1]], 1.5 * voxel)
    if move is None:
        return None
    m = np.eye(4)
    m[:3, :3], m[:3, 3] = move
    return m.tolist()
