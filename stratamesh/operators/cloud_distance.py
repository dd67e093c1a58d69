"""Cloud-to-cloud distances: nearest neighbour, and vertical distance to a local plane."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from stratamesh.operators.neighbors import knn, moments_within, nearest_within, sources
from stratamesh.staging import staged

MOMENTS = ("n", "mx", "my", "mz", "xx", "xy", "xz", "yy", "yz", "zz")


def nearest(source: DataFrame, target: DataFrame, start: float | None = None) -> DataFrame:
    """(source_id, target_id, distance) for every source, however far: the reach grows for those that have found nothing."""
    return knn(source, target, 1, start).select("source_id", "target_id", "distance")


def distances_within(source: DataFrame, target: DataFrame, reach: float | None) -> DataFrame:
    """(source_id, target_id, distance) for every source: infinity and -1 beyond a reach, which must be finite."""
    if reach is None:
        raise ValueError("a finite distance is needed")
    got = nearest_within(source, target, reach, keep_all=True)
    return got.select("source_id", F.coalesce("target_id", F.lit(-1)).alias("target_id"), F.coalesce("distance", F.lit(float("inf"))).alias("distance"))


def moments(pairs: DataFrame, *more: Column) -> DataFrame:
    """(source_id, sx, sy, sz, MOMENTS): counts, means and centred second moments of every source's targets, relative to the source; and `more` aggregates."""
    rel = {"rx": F.col("tx") - F.col("sx"), "ry": F.col("ty") - F.col("sy"), "rz": F.col("tz") - F.col("sz")}
    g = pairs.withColumns(rel).groupBy("source_id", "sx", "sy", "sz").agg(
        F.count(F.lit(1)).alias("n"), *(F.avg(f"r{c}").alias(f"m{c}") for c in "xyz"),
        *(F.covar_pop(f"r{a}", f"r{b}").alias(f"{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")), *more)
    return g


def unit_normals(rows: DataFrame) -> DataFrame:
    """Adds nx, ny, nz: the direction of least spread of MOMENTS, upward; and gap, how far the two least eigenvalues lie apart (over the largest)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m = np.stack([b[c].to_numpy() for c in ("xx", "xy", "xz", "xy", "yy", "yz", "xz", "yz", "zz")], 1).reshape(-1, 3, 3)
            values, vectors = np.linalg.eigh(m)
            v = vectors[:, :, 0]
            v = np.where(v[:, 2:] < 0, -v, v)
            yield b.assign(nx=v[:, 0], ny=v[:, 1], nz=v[:, 2], gap=(values[:, 1] - values[:, 0]) / np.maximum(values[:, 2], 1e-300))

    schema = StructType([*rows.schema.fields, *(StructField(c, DoubleType()) for c in ("nx", "ny", "nz", "gap"))])
    return rows.mapInPandas(run, schema)


def vertical_distances(source: DataFrame, target: DataFrame, radius: float | None = None, k: int = 20, least: int = 6) -> DataFrame:
    """(source_id, target_id, distance) of every source: its height over the plane fitted to its targets within radius, or to its k nearest.

    Null, and target_id -1, with fewer than `least` targets or an upright plane; else target_id is the nearest target of those used. Moments and the
    nearest target come from one aggregation of the pairs.
    """
    s = source.select("point_id", "x", "y", "z")
    if radius:
        m = moments_within(s, target, radius, nearest=True)
    else:
        # sources at one place have one plane
        at = s.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL").groupBy("x", "y", "z").agg(F.min("point_id").alias("point_id"))
        at = staged(at.select("point_id", "x", "y", "z"), "places")
        pairs = knn(at, target, k).join(sources(at), "source_id")
        least_far = F.min(F.when(F.col("rank") == 1, F.col("target_id"))).alias("target_id")
        m = moments(pairs, least_far)
    fitted = unit_normals(m.where(F.col("n") >= least)).where(F.abs("nz") >= 1e-9)
    # the plane's height at the source, which is the origin
    plane = F.col("mz") + (F.col("nx") * F.col("mx") + F.col("ny") * F.col("my")) / F.col("nz")
    if radius:
        got = s.select(F.col("point_id").alias("source_id")).join(fitted.select("source_id", "target_id", (-plane).alias("distance")), "source_id", "left")
    else:
        found = fitted.select(F.col("sx").alias("x"), F.col("sy").alias("y"), F.col("sz").alias("z"), "target_id", (-plane).alias("distance"))
        got = s.withColumnRenamed("point_id", "source_id").join(found, ["x", "y", "z"], "left")
    return got.select("source_id", F.coalesce("target_id", F.lit(-1)).alias("target_id"), "distance")
