"""Scalar expressions on points: moves, distances, cells."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Matrix = Sequence[Sequence[float]]
IDENTITY: Matrix = ((1.0, 0.0, 0.0, 0.0), (0.0, 1.0, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0), (0.0, 0.0, 0.0, 1.0))


@dataclass(frozen=True)
class Bounds:
    min_x: float
    min_y: float
    max_x: float
    max_y: float

    def padded(self, by: float) -> Bounds:
        return Bounds(self.min_x - by, self.min_y - by, self.max_x + by, self.max_y + by)

    def intersects(self, other: Bounds) -> bool:
        """Edges that touch count."""
        return self.min_x <= other.max_x and other.min_x <= self.max_x and self.min_y <= other.max_y and other.min_y <= self.max_y

    @property
    def area(self) -> float:
        return (self.max_x - self.min_x) * (self.max_y - self.min_y)


def grid_shape(b: Bounds, cell: float) -> tuple[int, int]:
    """(nx, ny): one more cell than the extent needs, so that the upper edge has a cell of its own."""
    if cell <= 0:
        raise ValueError("cell must be positive")
    return math.ceil((b.max_x - b.min_x) / cell) + 1, math.ceil((b.max_y - b.min_y) / cell) + 1


def _index(value: Column, low: float, cell: float) -> Column:
    return F.floor((value - F.lit(low)) / F.lit(cell))


def cell_clamped(value: Column, low: float, cell: float, n: int) -> Column:
    """The cell of a value; values outside fall into the edge cells."""
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), _index(value, low, cell))).cast("int")


def cell_strict(value: Column, low: float, cell: float, n: int) -> Column:
    """The cell of a value; null outside."""
    i = _index(value, low, cell)
    return F.when((i >= 0) & (i < n), i.cast("int"))


def cell_centre(index: Column, low: float, cell: float) -> Column:
    return F.lit(low) + (index + F.lit(0.5)) * F.lit(cell)


def moved(m: Matrix, x: str = "x", y: str = "y", z: str = "z") -> list[Column]:
    """x, y and z after p' = R p + t: three linear expressions with literals."""
    at = [F.col(x), F.col(y), F.col(z)]
    return [sum((F.lit(float(m[i][j])) * at[j] for j in range(1, 3)), F.lit(float(m[i][0])) * at[0]) + F.lit(float(m[i][3])) for i in range(3)]


def squared_distance(a: Sequence[str], b: Sequence[str]) -> Column:
    return sum(((F.col(q) - F.col(p)) * (F.col(q) - F.col(p)) for p, q in zip(a[1:], b[1:], strict=True)), (F.col(b[0]) - F.col(a[0])) * (F.col(b[0]) - F.col(a[0])))


def distance(a: Sequence[str], b: Sequence[str]) -> Column:
    """Between two points of one row."""
    return F.sqrt(squared_distance(a, b))


def compose(a: Matrix, b: Matrix) -> list[list[float]]:
    """a after b."""
    return [[sum(a[i][k] * b[k][j] for k in range(4)) for j in range(4)] for i in range(4)]
