"""Thinner clouds: outliers taken out, one point for each voxel or octree cell, a random share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamesh.operators.neighbors import knn
from stratamesh.operators.sampling import sample


def without_outliers(points: DataFrame, k: int = 6, deviations: float = 1.0) -> DataFrame:
    """Points whose mean distance to their k nearest others is at most the cloud's mean of that plus some standard deviations, with mean_distance."""
    near = knn(points, points, k + 1)
    mean = near.groupBy("source_id").agg((F.sum("distance") / F.greatest(F.lit(1), F.count(F.lit(1)) - 1)).alias("mean_distance"))
    row = mean.agg(F.avg("mean_distance"), F.stddev_pop("mean_distance")).first()
    kept = mean.where(F.col("mean_distance") <= row[0] + deviations * row[1]).withColumnRenamed("source_id", "point_id")
    return points.join(kept, "point_id")


def _one_per(points: DataFrame, cells: list[Column], rank: list[Column]) -> DataFrame:
    """Of every cell the row with the least rank: one aggregation with partial minima, which carries the row along."""
    row = F.struct(*points.columns)
    least = points.groupBy(*(c.alias(f"_v{i}") for i, c in enumerate(cells))).agg(F.min_by(row, F.struct(*rank)).alias("_row"))
    return least.select("_row.*")


def one_per_voxel(points: DataFrame, size: float) -> DataFrame:
    """Of every voxel the point with the least id."""
    return _one_per(points, [F.floor(F.col(c) / F.lit(size)) for c in "xyz"], [F.col("point_id")])


def octree(points: DataFrame, level: int, corner: tuple[float, float, float] | None = None, side: float | None = None) -> DataFrame:
    """Of every cell of an octree's level (2**level cells along each axis of a cube around all points) the point nearest to its centre; ties to the least id.

    corner and side: the cube, if it is known; else it comes from the points' box. Cells are closed below; the upper faces belong to the last.
    """
    if not 0 <= level <= 20:
        raise ValueError("level: 0 to 20")
    if corner is None or side is None:
        box = points.agg(*(f(c) for c in "xyz" for f in (F.min, F.max))).first()
        if box[0] is None:
            return points
        corner, side = tuple(box[::2]), max(hi - lo for lo, hi in zip(box[::2], box[1::2], strict=True)) or 1.0
    cell = side / 2**level
    at = [F.least(F.floor((F.col(c) - F.lit(float(lo))) / F.lit(cell)), F.lit(2**level - 1)) for c, lo in zip("xyz", corner, strict=True)]
    off = [F.col(c) - (F.lit(float(lo)) + (a + 0.5) * F.lit(cell)) for c, lo, a in zip("xyz", corner, at, strict=True)]
    return _one_per(points, at, [off[0] * off[0] + off[1] * off[1] + off[2] * off[2], F.col("point_id")])


def random_share(points: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n points by a hash of their ids, the same on every run; all if there are fewer."""
    return sample(points, n, seed=seed)
