"""Rigid moves and shifts between global and local frames."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamesh.functions.geometry import Bounds, Matrix, moved


def apply_transform(points: DataFrame, matrix: Matrix) -> DataFrame:
    """Points after p' = R p + t; other columns stay."""
    return points.withColumns(dict(zip("xyz", moved(matrix), strict=True)))


@dataclass(frozen=True)
class LocalFrame:
    """local = global - offset. z is shifted only where offset_z isn't 0."""

    offset_x: float = 0.0
    offset_y: float = 0.0
    offset_z: float = 0.0
    origin_method: str = "identity"

    def _shift(self, points: DataFrame, sign: float) -> DataFrame:
        cols = {"x": F.col("x") + F.lit(sign * self.offset_x), "y": F.col("y") + F.lit(sign * self.offset_y)}
        if self.offset_z:
            cols["z"] = F.col("z") + F.lit(sign * self.offset_z)
        return points.withColumns(cols)

    def to_local(self, points: DataFrame) -> DataFrame:
        return self._shift(points, -1.0)

    def to_global(self, points: DataFrame) -> DataFrame:
        return self._shift(points, 1.0)

    def bounds_to_local(self, b: Bounds) -> Bounds:
        return Bounds(b.min_x - self.offset_x, b.min_y - self.offset_y, b.max_x - self.offset_x, b.max_y - self.offset_y)

    def bounds_to_global(self, b: Bounds) -> Bounds:
        return Bounds(b.min_x + self.offset_x, b.min_y + self.offset_y, b.max_x + self.offset_x, b.max_y + self.offset_y)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> LocalFrame:
        """Fields that are missing have their defaults."""
        d = json.loads(text)
        return cls(float(d.get("offset_x", 0)), float(d.get("offset_y", 0)), float(d.get("offset_z", 0)), str(d.get("origin_method", "identity")))


def local_frame(points: DataFrame, method: str = "min_bounds", include_z: bool = False) -> LocalFrame:
    """The frame whose origin is the points' least corner, centroid or first point (least id); identity: no shift. ValueError without points."""
    if method == "identity":
        return LocalFrame()
    if method == "first_point":
        row = points.orderBy("point_id").select("x", "y", "z").first()
    elif method in ("min_bounds", "centroid"):
        f = F.min if method == "min_bounds" else F.avg
        row = points.agg(*(f(c).alias(c) for c in "xyz")).first()
    else:
        raise ValueError(f"unknown origin method {method}")
    if row is None or row["x"] is None:
        raise ValueError("no points to take an origin from")
    return LocalFrame(row["x"], row["y"], row["z"] if include_z else 0.0, method)


def matrix_to_text(m: Matrix) -> str:
    return "\n".join(" ".join(repr(float(v)) for v in row) for row in m) + "\n"


def matrix_from_text(text: str) -> list[list[float]]:
    """A 4 x 4 matrix; ValueError for any other shape."""
    m = [[float(v) for v in line.split()] for line in text.splitlines() if line.strip()]
    if len(m) != 4 or any(len(r) != 4 for r in m):
        raise ValueError("a transform has four rows of four numbers")
    return m
