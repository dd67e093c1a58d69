"""A whole run: two epochs in, aligned and compared, results out as lazy tables."""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamesh.functions.geometry import IDENTITY, Matrix
from stratamesh.operators import cloud_distance, cylinder, grid, registration, sampling, statistics
from stratamesh.operators.clip import ClipArea, clip
from stratamesh.operators.filters import filter_classes
from stratamesh.operators.transforms import LocalFrame, apply_transform, local_frame
from stratamesh.plans.config import Settings

log = logging.getLogger("stratamesh")


@dataclass
class Outcome:
    frame: LocalFrame
    matrix: Matrix
    rmse: float
    aligned: DataFrame
    dod: DataFrame | None = None
    dod_stats: DataFrame | None = None
    c2c: DataFrame | None = None
    c2c_stats: DataFrame | None = None
    m3c2: DataFrame | None = None
    m3c2_stats: DataFrame | None = None


def align(t1: DataFrame, t2: DataFrame, s: Settings) -> tuple[Matrix, float]:
    """The move of the second epoch onto the first, fitted on samples, and its error there."""
    a, b = (sampling.sample(p, s.icp.points, seed=s.seed) for p in (t1, t2))
    start: Matrix = registration.coarse(b, a, s.coarse.method, s.coarse.phase_cell) if s.coarse.enabled else IDENTITY
    if not s.icp.enabled:
        return start, registration.registration_error(apply_transform(b, start), a, s.icp.reach)
    fine = {"reach": s.icp.reach, "iterations": s.icp.iterations, "tolerance": s.icp.tolerance, "shift_eps": s.icp.shift_eps, "turn_eps_degrees": s.icp.turn_eps_degrees}
    if s.multiscale.enabled:
        got = registration.multiscale_icp(b, a, start, s.multiscale.reach, s.multiscale.points, s.multiscale.iterations, **fine)
    else:
        got = registration.icp(b, a, start, **fine)
    return got.matrix, got.rmse


def compare_epochs(t1: DataFrame, t2: DataFrame, settings: Settings | None = None, boundary: ClipArea | None = None) -> Outcome:
    """Runs the enabled comparisons of two clouds (point_id, x, y, z, classification).

    The moved second epoch is one projection, applied before anything is cut or gridded; results are in the local frame.
    ValueError if an epoch has no points left.
    """
    s = settings or Settings()
    t1, t2 = (filter_classes(p, s.preprocessing.ground_only, s.preprocessing.classes) for p in (t1, t2))
    frame = local_frame(t1, s.coordinates.origin, s.coordinates.include_z) if s.coordinates.local else LocalFrame()
    t1, t2 = frame.to_local(t1), frame.to_local(t2)
    if boundary:
        boundary = boundary.shifted(-frame.offset_x, -frame.offset_y)
        t1, t2 = clip(t1, boundary), clip(t2, boundary)
    if not t1.limit(1).count() or not t2.limit(1).count():
        raise ValueError("an epoch has no points")
    matrix, rmse = align(t1, t2, s)
    log.info("aligned with an error of %.4f", rmse)
    moved = apply_transform(t2, matrix)
    out = Outcome(frame, matrix, rmse, moved)
    if s.dod.enabled:
        out.dod = grid.dod(t1, moved, s.dod.cell, aggregate=s.dod.aggregate, centres=True)
        out.dod_stats = grid.dod_statistics(out.dod)
    if s.c2c.enabled:
        if s.c2c.mode == "vertical_plane":
            out.c2c = cloud_distance.vertical_distances(moved, t1, s.c2c.radius, s.c2c.k, s.c2c.least)
        elif s.c2c.reach is None:
            out.c2c = cloud_distance.nearest(moved, t1)
        else:
            out.c2c = cloud_distance.distances_within(moved, t1, s.c2c.reach)
        out.c2c_stats = statistics.distance_statistics(out.c2c.where(F.abs("distance") < math.inf), cutoff=s.c2c.reach)
    if s.m3c2.enabled:
        m = s.m3c2
        p = cylinder.autotune(t1, neighbors=m.neighbors, depth_factor=m.depth_factor, least=m.least_radius, most=m.most_radius) if m.autotune else cylinder.CylinderParams(m.radius, m.radius, m.depth)
        cores = sampling.core_points(t1, m.core_percent, m.core_count, s.seed)
        out.m3c2 = cylinder.compare(cores, t1, moved, p, registration_error=0.0)
        out.m3c2_stats = statistics.change_statistics(out.m3c2)
    return out


def save(outcome: Outcome, folder: str) -> list[str]:
    """Writes every table of an outcome as Parquet, points in global coordinates. Returns the paths."""
    paths = []
    for name in ("dod", "dod_stats", "c2c", "c2c_stats", "m3c2", "m3c2_stats"):
        df = getattr(outcome, name)
        if df is not None:
            df = outcome.frame.to_global(df) if name == "m3c2" else df
            paths.append(f"{folder.rstrip('/')}/{name}")
            df.write.mode("overwrite").parquet(paths[-1])
    return paths
