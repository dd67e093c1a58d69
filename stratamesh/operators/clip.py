"""Clipping to polygons: rings of vertices, the first outside, the rest holes; several polygons together."""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamesh.functions.geometry import Bounds
from stratamesh.operators.filters import in_box

Ring = tuple[tuple[float, float], ...]
#: Edges up to which the test is a plain expression, compiled with its stage; beyond, a fold over a constant array.
INLINE_EDGES = 96
#: Edges beyond which points meet a table of slabs instead, which holds the edges around a point's y alone.
SLAB_EDGES = 512
#: Vertices a slab has in the mean; copies of edges the table may hold for each edge, in the mean; edge copies up to which it is broadcast (about 64 MB).
SLAB_VERTICES, SLAB_COPIES, BROADCAST_COPIES = 8, 8, 1_000_000


def _open(ring: Sequence[Sequence[float]]) -> Ring:
    pts = [(float(p[0]), float(p[1])) for p in ring]
    if len(pts) > 1 and pts[0] == pts[-1]:
        pts.pop()
    if len(pts) < 3 or not all(math.isfinite(v) for p in pts for v in p):
        raise ValueError("a ring needs three finite vertices at least")
    return tuple(pts)


@dataclass(frozen=True)
class ClipArea:
    polygons: tuple[tuple[Ring, ...], ...]

    @classmethod
    def of(cls, *polygons: Sequence[Sequence[Sequence[float]]]) -> ClipArea:
        """Each polygon is a list of rings."""
        if not polygons:
            raise ValueError("no polygon")
        return cls(tuple(tuple(_open(r) for r in p) for p in polygons))

    @classmethod
    def box(cls, b: Bounds) -> ClipArea:
        return cls.of([[(b.min_x, b.min_y), (b.max_x, b.min_y), (b.max_x, b.max_y), (b.min_x, b.max_y)]])

    @classmethod
    def from_geojson(cls, text: str, feature: str | None = None) -> ClipArea:
        """A FeatureCollection, Feature, Polygon or MultiPolygon. `feature`: the first non-empty of name, id, NAME and Id must equal it. ValueError if nothing is left."""
        doc = json.loads(text)
        kind = doc.get("type")
        features = doc.get("features", []) if kind == "FeatureCollection" else [doc] if kind == "Feature" else [{"geometry": doc, "properties": {}}]
        out = []
        for f in features:
            if feature is not None:
                p = f.get("properties") or {}
                if str(next((p[k] for k in ("name", "id", "NAME", "Id") if p.get(k)), "")) != feature:
                    continue
            g = f.get("geometry") or {}
            if g.get("type") == "Polygon":
                out.append(g["coordinates"])
            elif g.get("type") == "MultiPolygon":
                out += g["coordinates"]
        if not out:
            raise ValueError("no polygons found")
        return cls.of(*out)

    @classmethod
    def from_shapefile(cls, content: bytes) -> ClipArea:
        """The polygons of an .shp file's content (shape types 5, 15 and 25). Rings that run clockwise are outlines, the others holes of the outline before them. ValueError if nothing is left."""
        if len(content) < 100 or struct.unpack_from(">i", content, 0)[0] != 9994:
            raise ValueError("not a shapefile")
        at, out = 100, []
        while at + 12 <= len(content):
            words = struct.unpack_from(">i", content, at + 4)[0]
            kind = struct.unpack_from("<i", content, at + 8)[0]
            if kind in (5, 15, 25):
                parts, points = struct.unpack_from("<2i", content, at + 44)
                first = [*struct.unpack_from(f"<{parts}i", content, at + 52), points]
                flat = struct.unpack_from(f"<{2 * points}d", content, at + 52 + 4 * parts)
                for a, b in zip(first, first[1:], strict=False):
                    ring = list(zip(flat[2 * a : 2 * b : 2], flat[2 * a + 1 : 2 * b : 2], strict=True))
                    if _turn(ring) <= 0 or not out:
                        out.append([ring])
                    else:
                        out[-1].append(ring)
            elif kind != 0:
                raise ValueError(f"shape type {kind} isn't a polygon")
            at += 8 + 2 * words
        if not out:
            raise ValueError("no polygons found")
        return cls.of(*out)

    def to_shapefile(self) -> bytes:
        """An .shp file's content, a record for each polygon."""
        records = b""
        for n, poly in enumerate(self.polygons, 1):
            rings = [[*r, r[0]] if (_turn(r) <= 0) == (i == 0) else [*r[::-1], r[-1]] for i, r in enumerate(poly)]
            flat = [v for r in rings for p in r for v in p]
            starts = [sum(map(len, rings[:i])) for i in range(len(rings))]
            body = struct.pack("<i4d2i", 5, min(flat[::2]), min(flat[1::2]), max(flat[::2]), max(flat[1::2]), len(rings), len(flat) // 2) + struct.pack(f"<{len(rings)}i", *starts) + struct.pack(f"<{len(flat)}d", *flat)
            records += struct.pack(">2i", n, len(body) // 2) + body
        b = self.bounds
        return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(records)) // 2) + struct.pack("<2i8d", 1000, 5, b.min_x, b.min_y, b.max_x, b.max_y, 0, 0, 0, 0) + records

    def to_geojson(self) -> str:
        closed = [[[list(p) for p in (*r, r[0])] for r in poly] for poly in self.polygons]
        g = {"type": "Polygon", "coordinates": closed[0]} if len(closed) == 1 else {"type": "MultiPolygon", "coordinates": closed}
        return json.dumps({"type": "Feature", "properties": {}, "geometry": g})

    @property
    def bounds(self) -> Bounds:
        xs, ys = zip(*(p for poly in self.polygons for r in poly for p in r), strict=True)
        return Bounds(min(xs), min(ys), max(xs), max(ys))

    @property
    def area(self) -> float:
        """Holes taken off."""
        return sum(_ring_area(poly[0]) - sum(map(_ring_area, poly[1:])) for poly in self.polygons)

    def shifted(self, dx: float, dy: float) -> ClipArea:
        return ClipArea(tuple(tuple(tuple((x + dx, y + dy) for x, y in r) for r in poly) for poly in self.polygons))

    def contains(self, x: Column, y: Column) -> Column:
        """Whether a point lies inside a polygon: an odd number of its edges pass to the right. A lower or left edge may count as inside, an upper or right one not."""
        inside = F.lit(False)
        for poly in self.polygons:
            edges = [(a, b) for r in poly for a, b in zip(r, r[1:] + r[:1], strict=True) if a[1] != b[1]]
            if len(edges) <= INLINE_EDGES:
                odd = F.lit(False)
                for (x1, y1), (x2, y2) in edges:
                    hit = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < F.lit((x2 - x1) / (y2 - y1)) * (y - F.lit(y1)) + F.lit(x1))
                    odd = odd != hit
            else:
                rows = [{"y1": a[1], "y2": b[1], "s": (b[0] - a[0]) / (b[1] - a[1]), "x1": a[0]} for a, b in edges]
                table = F.from_json(F.lit(json.dumps(rows)), "array<struct<y1:double,y2:double,s:double,x1:double>>")
                odd = F.aggregate(table, F.lit(False), lambda a, e: a != (((e["y1"] > y) != (e["y2"] > y)) & (x < e["s"] * (y - e["y1"]) + e["x1"])))
            inside = inside | odd
        return inside

    @property
    def n_edges(self) -> int:
        return sum(len(r) for poly in self.polygons for r in poly)

    def sql(self, x: str = "x", y: str = "y") -> str:
        """contains() in SQL."""
        polys = []
        for poly in self.polygons:
            edges = [(a, b) for r in poly for a, b in zip(r, r[1:] + r[:1], strict=True) if a[1] != b[1]]
            terms = [f"CASE WHEN ({a[1]!r}::double > {y}) <> ({b[1]!r}::double > {y}) AND {x} < {(b[0] - a[0]) / (b[1] - a[1])!r}::double * ({y} - {a[1]!r}::double) + {a[0]!r}::double THEN 1 ELSE 0 END" for a, b in edges]
            polys.append(f"(({' + '.join(terms)}) % 2 = 1)")
        return "(" + " OR ".join(polys) + ")"


def _turn(r: Sequence[Sequence[float]]) -> float:
    """Positive for rings that run anticlockwise."""
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, [*r[1:], r[0]], strict=True))


def _ring_area(r: Ring) -> float:
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:] + r[:1], strict=True))) / 2


@dataclass(frozen=True)
class EdgeSlabs:
    """Edges under the slabs of y they reach into. Slab k holds y from bounds[k] to below bounds[k + 1].

    Bounds are quantiles of the vertices, so a detailed stretch of an outline has more slabs. Edges that reach through many
    slabs are copied to each; slabs are made wider until there are SLAB_COPIES an edge at most, so the table grows with the
    outline, never with its square. A point is tested against the edges of its slab: some SLAB_VERTICES and those that pass by.
    """

    bounds: np.ndarray
    slab: np.ndarray
    polygon: np.ndarray
    edge: np.ndarray

    @classmethod
    def of(cls, area: ClipArea) -> EdgeSlabs:
        found = [(n, a[1], b[1], (b[0] - a[0]) / (b[1] - a[1]), a[0]) for n, poly in enumerate(area.polygons) for r in poly for a, b in zip(r, r[1:] + r[:1], strict=True) if a[1] != b[1]]
        if not found:
            return cls(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 4)))
        rows = np.array(found)
        low, high = rows[:, 1:3].min(1), rows[:, 1:3].max(1)
        ends, slabs = np.sort(np.concatenate([low, high])), max(1, len(rows) // SLAB_VERTICES)
        while True:
            bounds = np.unique(ends[np.linspace(0, len(ends) - 1, slabs + 1).astype(np.int64)])
            first, last = np.searchsorted(bounds, low, "right") - 1, np.searchsorted(bounds, high, "left") - 1
            copies = last - first + 1
            if slabs == 1 or copies.sum() <= SLAB_COPIES * len(rows):
                break
            slabs //= 2
        which = np.repeat(np.arange(len(rows)), copies)
        slab = np.arange(copies.sum()) - np.repeat(copies.cumsum() - copies, copies) + first[which]
        order = np.lexsort((rows[which, 0], slab))
        return cls(bounds, slab[order], rows[which[order], 0].astype(np.int64), rows[which[order], 1:])

    def table(self, spark: SparkSession) -> DataFrame:
        """(slab, outlines): the edges of a slab, polygon by polygon."""
        n = len(self.slab)
        new_slab = np.r_[True, self.slab[1:] != self.slab[:-1]][:n]
        new_part = new_slab | np.r_[True, self.polygon[1:] != self.polygon[:-1]][:n]
        part = np.flatnonzero(new_part)
        edges = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in self.edge.T], ["y1", "y2", "s", "x1"])
        parts = pa.ListArray.from_arrays(pa.array(np.r_[part, n], pa.int32()), edges)
        outlines = pa.ListArray.from_arrays(pa.array(np.r_[np.flatnonzero(new_slab[part]), len(part)], pa.int32()), parts)
        return spark.createDataFrame(pa.table({"slab": pa.array(self.slab[new_slab]), "outlines": outlines}))

    def slab_of(self, y: Column) -> Column:
        """The slab of a y between the outermost bounds, by bisection of a constant array."""
        bounds = F.from_json(F.lit(json.dumps(self.bounds.tolist())), "array<double>")
        steps = [1 << i for i in reversed(range(max(1, len(self.bounds)).bit_length()))]
        return F.aggregate(F.array(*(F.lit(s).cast("long") for s in steps)), F.lit(0).cast("long"), lambda at, s: F.when((at + s < len(self.bounds)) & (F.get(bounds, (at + s).cast("int")) <= y), at + s).otherwise(at))


def _with_inside(points: DataFrame, area: ClipArea, name: str) -> DataFrame:
    """points and a boolean: inside the box and the area; false or null for others. Each row stays one row.

    Outlines of many edges are a table keyed by slab, broadcast up to BROADCAST_COPIES edges; a longer one is joined by slab, where
    adaptive execution splits a slab that holds much of the cloud. Points outside the box have no slab and meet no edge.
    """
    box = in_box(area.bounds)
    if area.n_edges <= SLAB_EDGES:
        return points.withColumn(name, box & area.contains(F.col("x"), F.col("y")))
    index, at = EdgeSlabs.of(area), {c: f"c{i}" for i, c in enumerate(points.columns)}  # inside, columns go by their places
    if not len(index.slab):
        return points.withColumn(name, F.lit(False))
    x, y = F.col(at["x"]), F.col(at["y"])
    placed = points.withColumn(name, F.when(box, index.slab_of(F.col("y")))).select(*(F.col(f"`{c}`").alias(a) for c, a in at.items()), F.col(name).alias("key"))
    slabs = index.table(points.sparkSession)
    met = placed.join(F.broadcast(slabs) if len(index.slab) <= BROADCAST_COPIES else slabs, F.col("key") == F.col("slab"), "left")
    odd = lambda part: F.aggregate(part, F.lit(False), lambda a, e: a != (((e["y1"] > y) != (e["y2"] > y)) & (x < e["s"] * (y - e["y1"]) + e["x1"])))
    return met.select(*(F.col(a).alias(c) for c, a in at.items()), F.coalesce(F.exists("outlines", odd), F.lit(False)).alias(name))


def _unused(points: DataFrame) -> str:
    name = "inside"
    while name in points.columns:
        name += "_"
    return name


def clip(points: DataFrame, area: ClipArea) -> DataFrame:
    """Points inside. The box goes to the scan, the exact test runs on what it leaves; attributes come along. Points without a finite place are outside."""
    name = _unused(points)
    return _with_inside(points.where(in_box(area.bounds)), area, name).where(F.col(name)).select(*(F.col(f"`{c}`") for c in points.columns))


def clip_statistics(points: DataFrame, area: ClipArea) -> DataFrame:
    """(total, inside, outside, percent_inside, area)."""
    counted = _with_inside(points.select("x", "y"), area, "in").agg(F.count(F.lit(1)).alias("total"), F.count_if("in").alias("inside"))
    return counted.select("total", "inside", (F.col("total") - F.col("inside")).alias("outside"), F.coalesce(F.try_divide(100.0 * F.col("inside"), F.col("total")), F.lit(0.0)).alias("percent_inside"), F.lit(area.area).alias("area"))
