"""Normal-oriented cylinder comparison of two epochs (after Lague et al. 2013), with a level of detection.

Own definitions where the literature leaves them open: one normal scale, normals upward, sample variances,
distance = (mean2 - mean1) along the normal, level = 1.96 * (sqrt(var1 / n1 + var2 / n2) + registration error).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamesh.functions.geometry import Bounds
from stratamesh.operators.around import Kernel, Sites, fold
from stratamesh.operators.cloud_distance import unit_normals
from stratamesh.operators.grid import in_tiles_meeting, tile_of
from stratamesh.operators.neighbors import XYZ_S, moments_within, sources, targets
from stratamesh.operators.range_sums import Region
from stratamesh.operators.sampling import percent_per
from stratamesh.operators.statistics import density
from stratamesh.staging import staged

Z95 = 1.96


@dataclass(frozen=True)
class CylinderParams:
    projection_scale: float
    cylinder_radius: float
    max_depth: float
    min_neighbors: int = 10
    normal_scale: float | None = None
    confidence: float = 0.95

    @property
    def reach(self) -> float:
        """How far a point of the cylinder can lie from its core, whichever way the normal points."""
        return math.hypot(self.cylinder_radius, self.max_depth)


def tuned(per_area: float, neighbors: int = 16, depth_factor: float = 0.6, least: float = 1.0, most: float = 20.0) -> CylinderParams:
    """Radius for `neighbors` expected points at a density of per_area, held to least..most."""
    r = least if per_area <= 0 else math.sqrt(neighbors / (math.pi * per_area))
    r = min(most, max(least, r))
    return CylinderParams(r, r, max(0.5, depth_factor * r), max(5, min(20, neighbors // 2)))


def autotune(points: DataFrame, **options) -> CylinderParams:
    """From the points' own box and number. ValueError without points."""
    row = density(points).first()
    if not row["n"]:
        raise ValueError("cannot tune on an empty cloud")
    return tuned(row["density"], **options)


def autotune_headers(headers: DataFrame, **options) -> CylinderParams:
    """From file headers (epoch, n_points, min_x, min_y, max_x, max_y): points of the first epoch over the box of all files."""
    first = headers.agg(F.min("epoch")).first()[0]
    row = headers.agg(F.sum(F.when(F.col("epoch") == first, F.col("n_points"))).alias("n"), F.min("min_x"), F.min("min_y"), F.max("max_x"), F.max("max_y")).first()
    if not row["n"]:
        raise ValueError("cannot tune without points")
    area = max(1e-6, (row[3] - row[1]) * (row[4] - row[2]))
    return tuned(row["n"] / area, **options)


def normals(cores: DataFrame, cloud: DataFrame, radius: float, least: int = 3) -> DataFrame:
    """(source_id, sx, sy, sz, nx, ny, nz, gap) of cores with `least` points of the cloud within radius."""
    return unit_normals(moments_within(cores, cloud, radius).where(F.col("n") >= least)).select("source_id", "sx", "sy", "sz", "nx", "ny", "nz", "gap")


def cylinder_statistics(oriented: DataFrame, t1: DataFrame, t2: DataFrame, p: CylinderParams, upright: bool = False) -> DataFrame:
    """(source_id, n1, mean1, var1, n2, mean2, var2): both epochs' points in the cylinders of oriented cores, by their place along the normal.

    Both epochs go through one join and one aggregation. upright: all normals are, so buckets need no more than the radius.
    """
    both = targets(t1).withColumn("side", F.lit(1)).unionByName(targets(t2).withColumn("side", F.lit(2)))
    sums = [f"{c}{i}" for i in (1, 2) for c in ("n", "m", "q")]
    query = XYZ_S if upright else (*XYZ_S, "nx", "ny", "nz")
    oriented = oriented.select("source_id", *query)
    got, _ = fold(oriented, both, p.cylinder_radius if upright else p.reach, _in_cylinders(p, upright), ", ".join(f"{c} double" for c in sums), query, added=True)
    got = got.groupBy("source_id").agg(*(F.sum(c).alias(c) for c in sums))
    mean = lambda i: F.col(f"m{i}") / F.col(f"n{i}")
    var = lambda i: F.greatest(F.lit(0.0), F.col(f"q{i}") - F.col(f"m{i}") * mean(i)) / (F.col(f"n{i}") - 1)
    of = lambda i: [F.col(f"n{i}").cast("long").alias(f"n{i}"), F.when(F.col(f"n{i}") > 0, mean(i)).alias(f"mean{i}"), F.when(F.col(f"n{i}") > 1, var(i)).alias(f"var{i}")]
    return got.select("source_id", *of(1), *of(2))


def _in_cylinders(p: CylinderParams, upright: bool) -> Kernel:
    """Of each side's points in the cylinder: their number, and sums of places along the normal and of their squares."""

    region = Region(p.cylinder_radius, p.max_depth, not upright)

    def run(there: Sites, q: np.ndarray) -> tuple[np.ndarray, list]:
        total = np.zeros((len(q), 6))
        for i in (1, 2):
            tree = there.sums(i)
            if tree is None:
                continue
            if upright:
                total[:, 3 * i - 3 : 3 * i] = tree.around(q, region, (0, 3, 9))[:, [0, 3, 9]]
            else:
                n, *m, xx, xy, xz, yy, yz, zz = tree.around(q, region).T
                a, b, c = q[:, 3:].T
                along = a * a * xx + b * b * yy + c * c * zz + 2 * (a * b * xy + a * c * xz + b * c * yz)
                total[:, 3 * i - 3 : 3 * i] = np.stack([n, m[0] * a + m[1] * b + m[2] * c, along], 1)
        found = np.flatnonzero(total[:, 0] + total[:, 3])
        return found, list(total[found].T)

    return run


def distance_and_level(registration_error: float = 0.0) -> tuple[Column, Column]:
    """(distance, level of detection) over the columns of cylinder_statistics(); null with an empty side, level null with fewer than two points on a side."""
    d = F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.col("mean2") - F.col("mean1"))
    lod = Z95 * (F.sqrt(F.col("var1") / F.col("n1") + F.col("var2") / F.col("n2")) + registration_error)
    return d, F.when((F.col("n1") > 1) & (F.col("n2") > 1), lod)


def _compared(cores: DataFrame, oriented: DataFrame, t1: DataFrame, t2: DataFrame, p: CylinderParams, registration_error: float, use_min: bool, upright: bool = False) -> DataFrame:
    stats = cylinder_statistics(oriented, t1, t2, p, upright)
    if use_min:
        stats = stats.where((F.col("n1") >= p.min_neighbors) & (F.col("n2") >= p.min_neighbors))
    d, lod = distance_and_level(registration_error)
    found = stats.select("source_id", d.alias("distance"), lod.alias("uncertainty"), "n1", "n2")
    out = cores.select(F.col("point_id").alias("source_id"), "x", "y", "z").join(found, "source_id", "left")
    return out.select(F.col("source_id").alias("core_id"), "x", "y", "z", "distance", "uncertainty", F.coalesce("n1", F.lit(0)).alias("n1"), F.coalesce("n2", F.lit(0)).alias("n2"))


def compare(cores: DataFrame, t1: DataFrame, t2: DataFrame, p: CylinderParams, registration_error: float = 0.0, use_min: bool = False) -> DataFrame:
    """(core_id, x, y, z, distance, uncertainty, n1, n2) of every core, along normals of the first epoch, which are written before points meet them. use_min: null with fewer than min_neighbors on a side."""
    oriented = staged(normals(cores, t1, p.normal_scale or p.projection_scale), "normals")
    return _compared(cores, oriented, t1, t2, p, registration_error, use_min)


def compare_upright(cores: DataFrame, t1: DataFrame, t2: DataFrame, p: CylinderParams, registration_error: float = 0.0) -> DataFrame:
    """compare() with upright cylinders."""
    return _compared(cores, sources(cores), t1, t2, p, registration_error, False, upright=True)


def compare_tiles(t1: DataFrame, t2: DataFrame, b: Bounds, tile: float, percent: float, p: CylinderParams, box: Bounds | None = None, seed: int = 0, cores_of: DataFrame | None = None) -> DataFrame:
    """compare() at a share of the first epoch's points of every tile (of cores_of's, if given), of tiles that meet the box only, with tile_i and tile_j. A tile with points has a core at least."""
    points = t1 if cores_of is None else cores_of
    tiled = tile_of(points, b, tile) if box is None else in_tiles_meeting(points, b, tile, box)
    cores = percent_per(tiled, ["tile_i", "tile_j"], percent, seed=seed)
    return compare(cores, t1, t2, p).join(cores.select(F.col("point_id").alias("core_id"), "tile_i", "tile_j"), "core_id")


def compare_planes(*_: object) -> DataFrame:
    raise NotImplementedError("plane-to-plane comparison isn't defined")
