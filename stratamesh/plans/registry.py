"""Name -> query and name -> SQL for the change-analytics operators, over lineitem as a two-epoch cloud."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamesh.functions.geometry import Bounds, distance, grid_shape
from stratamesh.operators import cloud_distance, cylinder, filters, grid, neighbors, raster, registration, sampling, statistics, thinning
from stratamesh.operators.clip import ClipArea, clip, clip_statistics
from stratamesh.operators.transforms import LocalFrame, apply_transform, local_frame
from stratamesh.sources.points import file_bounds, files_for_tiles, lineitem_points, lineitem_points_sql, synthetic, union_bounds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CELL, REACH = 25.0, 5.0
EXTENT, INNER = Bounds(0.0, 0.0, 1100.0, 1000.0), Bounds(200.0, 150.0, 820.0, 777.0)
TRIANGLE = ClipArea.of([[(50, 40), (990, 120), (480, 930)]])
HOLED = ClipArea.of([[(100, 100), (900, 100), (900, 900), (100, 900)], [(300, 300), (700, 300), (700, 700), (300, 700)]], [[(930, 40), (1000, 40), (1000, 200)]])
TURN = [[0.9998, -0.0175, 0.0087, 1.5], [0.0174, 0.9998, 0.0052, -0.7], [-0.0088, -0.0051, 0.9999, 0.3], [0.0, 0.0, 0.0, 1.0]]


def _turned(about_x: float, about_y: float, about_z: float, shift: tuple[float, float, float]) -> list[list[float]]:
    """A rigid move by angles in degrees, to the last digit, so that its inverse is known."""
    c, s = ([f(math.radians(a)) for a in (about_x, about_y, about_z)] for f in (math.cos, math.sin))
    rx = np.array([[1, 0, 0], [0, c[0], -s[0]], [0, s[0], c[0]]])
    ry = np.array([[c[1], 0, s[1]], [0, 1, 0], [-s[1], 0, c[1]]])
    rz = np.array([[c[2], -s[2], 0], [s[2], c[2], 0], [0, 0, 1]])
    m = np.eye(4)
    m[:3, :3], m[:3, 3] = rz @ ry @ rx, shift
    return m.tolist()


RIGID = _turned(-0.3, 0.5, 1.0, (1.5, -0.7, 0.3))
SHIFT = [[1, 0, 0, 50], [0, 1, 0, -30], [0, 0, 1, 0], [0, 0, 0, 1]]
FRAME = LocalFrame(466.25, 50.5, 10.0, "min_bounds")
PARAMS = cylinder.CylinderParams(2.0, 2.0, 2.0)


def register(name: str, sql: str | None = None, scale: float = 1.0, points: bool = True):
    """Registers f(points of the scale) or, without points, f(spark, sf_dir); sql may select from pts, those points."""

    def put(f):
        QUERIES[name] = (lambda spark, sf_dir: f(lineitem_points(spark, sf_dir, scale))) if points else f
        if sql is not None:
            ORACLES[name] = f"WITH pts AS ({lineitem_points_sql(scale)})\n{sql}" if points else sql
        return f

    return put


def epochs(pts: DataFrame, ground: bool = True) -> tuple[DataFrame, DataFrame]:
    kept = filters.filter_classes(pts, ground_only=ground)
    return kept.where("epoch = 't1'"), kept.where("epoch = 't2'")


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _cells(b: Bounds, cell: float, clamp: bool = True) -> tuple[str, str, str]:
    """(cell_x, cell_y, condition) in SQL."""
    nx, ny = grid_shape(b, cell)
    x, y = f"floor((x - {b.min_x!r}::double) / {cell!r}::double)", f"floor((y - {b.min_y!r}::double) / {cell!r}::double)"
    if clamp:
        return f"CAST(greatest(0, least({nx - 1}, {x})) AS INT)", f"CAST(greatest(0, least({ny - 1}, {y})) AS INT)", "true"
    return f"CAST({x} AS INT)", f"CAST({y} AS INT)", f"{x} BETWEEN 0 AND {nx - 1} AND {y} BETWEEN 0 AND {ny - 1}"


def _dod_sql(value: str, b: Bounds = EXTENT, clamp: bool = True, join: str = "JOIN", where: str = "classification = 2", cell: float = CELL) -> str:
    cx, cy, cond = _cells(b, cell, clamp)
    return f"""SELECT coalesce(a.cx, b.cx) AS cell_x, coalesce(a.cy, b.cy) AS cell_y, round(a.v, 6) AS dem1, round(b.v, 6) AS dem2, round(b.v - a.v, 6) AS dod
FROM (SELECT {cx} AS cx, {cy} AS cy, {value} AS v FROM pts WHERE epoch = 't1' AND {where} AND {cond} GROUP BY 1, 2) a
{join} (SELECT {cx} AS cx, {cy} AS cy, {value} AS v FROM pts WHERE epoch = 't2' AND {where} AND {cond} GROUP BY 1, 2) b ON a.cx = b.cx AND a.cy = b.cy"""


_MEAN = "avg(z)"
_VALUES = {"mean": _MEAN, "median": "median(z)", "p95": "quantile_cont(z, 0.95)", "p5": "quantile_cont(z, 0.05)"}
for _name, _value in _VALUES.items():

    @register(f"dod_{_name}", _dod_sql(_value))
    def _(pts, name=_name):
        return r6(grid.dod(*epochs(pts), cell=CELL, b=EXTENT, aggregate=name), "dem1", "dem2", "dod")


@register("dod_own_bounds", f"""SELECT a.cx AS cell_x, a.cy AS cell_y, round(b.v - a.v, 6) AS dod FROM
(SELECT CAST(floor((x - x0) / 25.0::double) AS INT) AS cx, CAST(floor((y - y0) / 25.0::double) AS INT) AS cy, {_MEAN} AS v FROM pts, (SELECT min(x) AS x0, min(y) AS y0 FROM pts WHERE classification = 2) WHERE epoch = 't1' AND classification = 2 GROUP BY 1, 2) a JOIN
(SELECT CAST(floor((x - x0) / 25.0::double) AS INT) AS cx, CAST(floor((y - y0) / 25.0::double) AS INT) AS cy, {_MEAN} AS v FROM pts, (SELECT min(x) AS x0, min(y) AS y0 FROM pts WHERE classification = 2) WHERE epoch = 't2' AND classification = 2 GROUP BY 1, 2) b ON a.cx = b.cx AND a.cy = b.cy""")  # fmt: skip
def _(pts):
    return r6(grid.dod(*epochs(pts), cell=CELL), "dod").select("cell_x", "cell_y", "dod")


@register("dod_outer", _dod_sql(_MEAN, join="FULL OUTER JOIN", cell=10.0))
def _(pts):
    return r6(grid.dod(*epochs(pts), cell=10.0, b=EXTENT, outer=True), "dem1", "dem2", "dod")


@register("dod_strict_index", _dod_sql(_MEAN, INNER, clamp=False))
def _(pts):
    return r6(grid.dod(*epochs(pts), cell=CELL, b=INNER, clamp=False), "dem1", "dem2", "dod")


@register("dod_clamped_index", _dod_sql(_MEAN, INNER))
def _(pts):
    return r6(grid.dod(*epochs(pts), cell=CELL, b=INNER), "dem1", "dem2", "dod")


@register("dod_clipped", _dod_sql(_MEAN, where=f"classification = 2 AND {TRIANGLE.sql()}"))
def _(pts):
    t1, t2 = epochs(pts)
    return r6(grid.dod(clip(t1, TRIANGLE), clip(t2, TRIANGLE), cell=CELL, b=EXTENT), "dem1", "dem2", "dod")


@register("dod_stats", f"SELECT count(dod) AS n_cells, round(avg(dod), 6) AS mean_change, round(median(dod), 6) AS median_change, round(sqrt(avg(dod * dod)), 6) AS rmse, round(min(dod), 6) AS min_change, round(max(dod), 6) AS max_change FROM ({_dod_sql(_MEAN).replace('round(b.v - a.v, 6)', 'b.v - a.v')})")
def _(pts):
    return r6(grid.dod_statistics(grid.dod(*epochs(pts), cell=CELL, b=EXTENT)), "mean_change", "median_change", "rmse", "min_change", "max_change")


def _tile_sql(b: Bounds, tile: float) -> tuple[str, str]:
    n = [max(1, -int(-(hi - lo) // tile)) for lo, hi in ((b.min_x, b.max_x), (b.min_y, b.max_y))]
    return tuple(f"CAST(greatest(0, least({k - 1}, floor(({c} - {lo!r}::double) / {tile!r}::double))) AS INT)" for c, lo, k in (("x", b.min_x, n[0]), ("y", b.min_y, n[1])))


_TI, _TJ = _tile_sql(EXTENT, 90.0)
_CX, _CY, _ = _cells(EXTENT, CELL)


@register("dem_mosaic", f"SELECT cell_x, cell_y, round(avg(v), 6) AS value FROM (SELECT {_CX} AS cell_x, {_CY} AS cell_y, {_TI} AS ti, {_TJ} AS tj, avg(z) AS v FROM pts GROUP BY 1, 2, 3, 4) GROUP BY 1, 2")
def _(pts):
    return r6(grid.mosaic(pts, EXTENT, CELL, 90.0), "value")


@register("dem_counts", f"SELECT {_CX} AS cell_x, {_CY} AS cell_y, round(avg(z), 6) AS value, count(*) AS n FROM pts GROUP BY 1, 2")
def _(pts):
    return r6(grid.dem(pts, EXTENT, CELL), "value")


@register("occupancy_grid", f"SELECT cell_x, cell_y, n, round(n / max(n) OVER (), 6) AS share FROM (SELECT {_CX} AS cell_x, {_CY} AS cell_y, count(*) AS n FROM pts GROUP BY 1, 2)")
def _(pts):
    return r6(grid.occupancy(pts, EXTENT, CELL), "share")


@register("voxel_downsample", "SELECT CAST(floor(x / 20) AS BIGINT) AS vx, CAST(floor(y / 20) AS BIGINT) AS vy, CAST(floor(z / 20) AS BIGINT) AS vz, round(avg(x), 9) AS x, round(avg(y), 9) AS y, round(avg(z), 9) AS z, count(*) AS n FROM pts GROUP BY floor(pts.x / 20), floor(pts.y / 20), floor(pts.z / 20)")
def _(pts):
    return grid.voxel_means(pts, 20.0).withColumns({c: F.round(c, 9) for c in "xyz"})


@register("tile_table", """SELECT CAST(i AS INT) AS tile_i, CAST(j AS INT) AS tile_j, i * 300.0::double AS min_x, j * 300.0::double AS min_y, least(1100.0::double, (i + 1) * 300.0::double) AS max_x, least(1000.0::double, (j + 1) * 300.0::double) AS max_y,
greatest(0.0::double, i * 300.0::double - 20) AS outer_min_x, greatest(0.0::double, j * 300.0::double - 20) AS outer_min_y, least(1100.0::double, least(1100.0::double, (i + 1) * 300.0::double) + 20) AS outer_max_x, least(1000.0::double, least(1000.0::double, (j + 1) * 300.0::double) + 20) AS outer_max_y FROM range(4) a(i), range(4) b(j)""", points=False)  # fmt: skip
def _(spark, sf_dir):
    return grid.tiles(spark, EXTENT, 300.0, 20.0)


@register("tile_files", """SELECT CAST(i AS INT) AS tile_i, CAST(j AS INT) AS tile_j, file FROM range(4) a(i), range(4) b(j), (SELECT epoch || '-' || CAST(floor(x / 400) AS BIGINT) || '-' || CAST(floor(y / 400) AS BIGINT) AS file, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM pts GROUP BY 1) f
WHERE x0 <= least(1100, (i + 1) * 300 + 20) AND x1 >= greatest(0, i * 300 - 20) AND y0 <= least(1000, (j + 1) * 300 + 20) AND y1 >= greatest(0, j * 300 - 20)""")  # fmt: skip
def _(pts):
    block = [F.floor(F.col(c) / 400).cast("string") for c in "xy"]
    files = file_bounds(pts.withColumn("file", F.concat_ws("-", "epoch", *block)))
    return files_for_tiles(grid.tiles(pts.sparkSession, EXTENT, 300.0, 20.0), files)


@register("tile_files_all", """SELECT CAST(i AS INT) AS tile_i, CAST(j AS INT) AS tile_j, file FROM range(4) a(i), range(4) b(j), (SELECT classification || '-' || epoch || '-' || CAST(floor(x / 250) AS BIGINT) || '-' || CAST(floor(y / 250) AS BIGINT) AS file, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM pts GROUP BY 1) f
WHERE x0 <= least(1100, (i + 1) * 300 + 20) AND x1 >= greatest(0, i * 300 - 20) AND y0 <= least(1000, (j + 1) * 300 + 20) AND y1 >= greatest(0, j * 300 - 20)""")  # fmt: skip
def _(pts):
    block = [F.floor(F.col(c) / 250).cast("string") for c in "xy"]
    files = file_bounds(pts.withColumn("file", F.concat_ws("-", F.col("classification").cast("string"), "epoch", *block)))
    return files_for_tiles(grid.tiles(pts.sparkSession, EXTENT, 300.0, 20.0), files)


@register("class_filter_stats", "SELECT count(*) AS total, count(*) FILTER (classification IN (2, 5)) AS kept, round(100.0::double * count(*) FILTER (classification IN (2, 5)) / count(*), 6) AS percent FROM pts")
def _(pts):
    return r6(filters.filter_statistics(pts, classes=[2, 5]), "percent")


@register("class_filter", "SELECT point_id, classification FROM pts WHERE classification = 2")
def _(pts):
    return filters.filter_classes(pts).select("point_id", "classification")


@register("class_histogram", "SELECT epoch, classification, count(*) AS n FROM pts GROUP BY 1, 2")
def _(pts):
    return statistics.class_histogram(pts, "epoch")


@register("top_classes", "SELECT classification, count(*) AS n FROM pts GROUP BY 1 ORDER BY n DESC, classification LIMIT 5")
def _(pts):
    return statistics.top_classes(pts)


@register("file_bounds", "SELECT epoch AS file, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y, count(*) AS n_points FROM pts GROUP BY 1")
def _(pts):
    return file_bounds(pts.withColumnRenamed("epoch", "file"))


@register("bounds_union", "SELECT min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM pts")
def _(pts):
    boxes = file_bounds(pts.withColumnRenamed("epoch", "file"))
    return union_bounds(boxes.where("file = 't1'"), boxes.where("file = 't2'"))


@register("bbox_filter", "SELECT point_id, x, y FROM pts WHERE x BETWEEN 200.0::double AND 820.0::double AND y BETWEEN 150.0::double AND 777.0::double")
def _(pts):
    return filters.filter_box(pts, INNER).select("point_id", "x", "y")


@register("polygon_clip", f"SELECT point_id, epoch, classification FROM pts WHERE {TRIANGLE.sql()}")
def _(pts):
    return clip(pts, TRIANGLE).select("point_id", "epoch", "classification")


@register("polygon_clip_hole", f"SELECT point_id FROM pts WHERE {HOLED.sql()}")
def _(pts):
    return clip(pts, HOLED).select("point_id")


def _shore(n: int) -> list[list[tuple[float, float]]]:
    """An outline whose two sides have n vertices each, by a rule that SQL can repeat without rounding, and a hole like it."""
    side = lambda x, step, up: [(x + step * ((i * 7919) % 64), 20.0 + 0.25 * i) for i in (range(n) if up else reversed(range(n)))]
    return [side(950.0, -0.5, True) + side(60.0, 0.5, False), [(x, y + 0.125) for x, y in side(600.0, 0.25, True)[8:-8] + side(400.0, 0.25, False)[8:-8]]]


SHORE_SIDE = 1800
SHORE = ClipArea.of(_shore(SHORE_SIDE))
#: The outline's edges in SQL: sides up and down, the hole's inside them, each vertex beside the next one of its ring.
_SHORE_EDGES = f"""v AS (SELECT 0 AS ring, i AS n, 950.0::double - 0.5::double * ((i * 7919) % 64) AS x, 20.0::double + 0.25::double * i AS y FROM range({SHORE_SIDE}) r(i)
  UNION ALL SELECT 0, {2 * SHORE_SIDE} - i, 60.0::double + 0.5::double * ((i * 7919) % 64), 20.0::double + 0.25::double * i FROM range({SHORE_SIDE}) r(i)
  UNION ALL SELECT 1, i, 600.0::double + 0.25::double * ((i * 7919) % 64), 20.125::double + 0.25::double * i FROM range(8, {SHORE_SIDE} - 8) r(i)
  UNION ALL SELECT 1, {2 * SHORE_SIDE} - i, 400.0::double + 0.25::double * ((i * 7919) % 64), 20.125::double + 0.25::double * i FROM range(8, {SHORE_SIDE} - 8) r(i)),
e AS (SELECT x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM v WINDOW w AS (PARTITION BY ring ORDER BY n)),
inside AS (SELECT point_id FROM pts JOIN e ON least(y1, y2) <= y AND greatest(y1, y2) > y AND (y1 > y) <> (y2 > y) AND x < (x2 - x1) / (y2 - y1) * (y - y1) + x1 WHERE y1 <> y2 GROUP BY point_id HAVING count(*) % 2 = 1)"""


@register("clip_long_outline", None)
def _(pts):
    return clip(pts, SHORE).select("point_id", "epoch", "classification")


ORACLES["clip_long_outline"] = f"WITH pts AS ({lineitem_points_sql(1.0)}), {_SHORE_EDGES}\nSELECT point_id, epoch, classification FROM pts WHERE point_id IN (SELECT point_id FROM inside)"


@register("clip_stats_long_outline", None)
def _(pts):
    return r6(clip_statistics(pts, SHORE).drop("area"), "percent_inside")


ORACLES["clip_stats_long_outline"] = f"WITH pts AS ({lineitem_points_sql(1.0)}), {_SHORE_EDGES}, n AS (SELECT count(*) AS total, count(*) FILTER (point_id IN (SELECT point_id FROM inside)) AS inside FROM pts)\nSELECT total, inside, total - inside AS outside, round(100.0::double * inside / total, 6) AS percent_inside FROM n"


@register("clip_stats", f"SELECT count(*) AS total, count(*) FILTER ({HOLED.sql()}) AS inside, count(*) FILTER (NOT {HOLED.sql()}) AS outside, round(100.0::double * count(*) FILTER ({HOLED.sql()}) / count(*), 6) AS percent_inside, {HOLED.area!r}::double AS area FROM pts")
def _(pts):
    return r6(clip_statistics(pts, HOLED), "percent_inside")


def _moved_sql(m, cols="xyz") -> str:
    return ", ".join(f"round({m[i][0]!r}::double * x + {m[i][1]!r}::double * y + {m[i][2]!r}::double * z + {m[i][3]!r}::double, 8) AS {c}" for i, c in enumerate(cols))


@register("rigid_transform", f"SELECT point_id, {_moved_sql(TURN)} FROM pts")
def _(pts):
    return apply_transform(pts, TURN).select("point_id", *(F.round(c, 8).alias(c) for c in "xyz"))


@register("to_local", "SELECT point_id, round(x - 466.25, 6) AS x, round(y - 50.5, 6) AS y, round(z - 10, 6) AS z FROM pts")
def _(pts):
    return r6(FRAME.to_local(pts), *"xyz").select("point_id", *"xyz")


@register("to_global", "SELECT point_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM pts")
def _(pts):
    return r6(FRAME.to_global(FRAME.to_local(pts)), *"xyz").select("point_id", *"xyz")


@register("local_frame_min", "SELECT point_id, round(x - (SELECT min(x) FROM pts), 6) AS x, round(y - (SELECT min(y) FROM pts), 6) AS y, z FROM pts")
def _(pts):
    return r6(local_frame(pts).to_local(pts), "x", "y").select("point_id", *"xyz")


@register("local_frame_centroid", "SELECT point_id, round(x - (SELECT avg(x) FROM pts), 5) AS x, round(y - (SELECT avg(y) FROM pts), 5) AS y, round(z - (SELECT avg(z) FROM pts), 5) AS z FROM pts")
def _(pts):
    return local_frame(pts, "centroid", include_z=True).to_local(pts).select("point_id", *(F.round(c, 5).alias(c) for c in "xyz"))


_PAIRS = "(SELECT point_id AS sid, x AS sx, y AS sy, z AS sz FROM pts WHERE epoch = 't2' AND classification = 2) s JOIN (SELECT point_id AS tid, x AS tx, y AS ty, z AS tz FROM pts WHERE epoch = 't1' AND classification = 2) t"
_D2 = "((tx - sx) * (tx - sx) + (ty - sy) * (ty - sy) + (tz - sz) * (tz - sz))"


def _near_sql(reach: float, more: str = "") -> str:
    return f"SELECT s.*, t.*, {_D2} AS d2{more} FROM {_PAIRS} ON tx BETWEEN sx - {reach} AND sx + {reach} AND ty BETWEEN sy - {reach} AND sy + {reach} WHERE {_D2} <= {reach * reach}"


_NEAREST = f"SELECT sid AS source_id, tid AS target_id, round(sqrt(d2), 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY d2, tid) AS r FROM ({_near_sql(REACH)})) WHERE r = 1"


def _nearest(pts: DataFrame) -> DataFrame:
    t1, t2 = epochs(pts)
    return neighbors.nearest_within(t2, t1, REACH)


@register("c2c_nn", _NEAREST)
def _(pts):
    return r6(_nearest(pts), "distance")


@register("c2c_tiled_inf", f"SELECT s.sid AS source_id, coalesce(n.target_id, -1) AS target_id, coalesce(n.distance, 'infinity'::double) AS distance FROM (SELECT point_id AS sid FROM pts WHERE epoch = 't2' AND classification = 2) s LEFT JOIN ({_NEAREST}) n ON s.sid = n.source_id")
def _(pts):
    t1, t2 = epochs(pts)
    return r6(cloud_distance.distances_within(t2, t1, REACH), "distance")


@register("c2c_stats", f"SELECT count(*) AS n, coalesce(round(avg(d), 6), 'nan'::double) AS mean, coalesce(round(median(d), 6), 'nan'::double) AS median, coalesce(round(sqrt(avg(d * d)), 6), 'infinity'::double) AS rmse FROM ({_NEAREST.replace('round(sqrt(d2), 6) AS distance', 'sqrt(d2) AS d')}) WHERE d <= 4")
def _(pts):
    return r6(statistics.distance_statistics(_nearest(pts), cutoff=4.0), "mean", "median", "rmse")


@register("c2c_unbounded", f"SELECT sid AS source_id, arg_min(tid, {{'d': d2, 'i': tid}}) AS target_id, round(sqrt(min(d2)), 6) AS distance FROM (SELECT s.*, t.*, {_D2} AS d2 FROM {_PAIRS} ON true) GROUP BY 1")
def _(pts):
    t1, t2 = epochs(pts)
    return r6(cloud_distance.nearest(t2, t1), "distance")


@register("radius_count", f"SELECT sid AS source_id, count(*) AS n FROM ({_near_sql(20.0)}) GROUP BY 1")
def _(pts):
    t1, t2 = epochs(pts)
    return neighbors.counts_within(t2, t1, 20.0)


@register("knn_k5", f"SELECT sid AS source_id, tid AS target_id, round(sqrt(d2), 6) AS distance, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY d2, tid) AS r FROM (SELECT s.*, t.*, {_D2} AS d2 FROM {_PAIRS} ON true)) WHERE r <= 5")
def _(pts):
    t1, t2 = epochs(pts)
    got = neighbors.knn(t2, t1, 5)
    return r6(got, "distance").select("source_id", "target_id", "distance", "rank")


@register("knn_self", f"SELECT sid AS source_id, min(d2) AS distance FROM (SELECT s.sid, {_D2} AS d2 FROM (SELECT point_id AS sid, x AS sx, y AS sy, z AS sz FROM pts WHERE classification = 2 AND epoch = 't1') s JOIN (SELECT x AS tx, y AS ty, z AS tz FROM pts WHERE classification = 2 AND epoch = 't1') t ON tx BETWEEN sx - 1 AND sx + 1 AND ty BETWEEN sy - 1 AND sy + 1) GROUP BY 1")
def _(pts):
    t1, _ = epochs(pts)
    return neighbors.nearest_within(t1, t1, 1.0).select("source_id", "distance")


@register("knn_self_k5", f"SELECT sid AS source_id, tid AS target_id, round(sqrt(d2), 6) AS distance, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY d2, tid) AS r FROM (SELECT s.*, t.*, {_D2} AS d2 FROM {_PAIRS.replace(chr(39) + 't2' + chr(39), chr(39) + 't1' + chr(39))} ON true)) WHERE r <= 5")
def _(pts):
    t1, _ = epochs(pts)
    return r6(neighbors.knn(t1, t1, 5), "distance").select("source_id", "target_id", "distance", "rank")


#: Moves exact ties off the middle before both sides round.
_NUDGE = 1.3e-8


@register("neighbour_moments", f"""SELECT sid AS source_id, count(*) AS n, {', '.join(f'round(avg(t{c} - s{c}) + {_NUDGE}, 6) AS m{c}' for c in 'xyz')}, {', '.join(f'round(covar_pop(t{a} - s{a}, t{b} - s{b}) + {_NUDGE}, 5) AS {a}{b}' for a, b in ('xx', 'xy', 'xz', 'yy', 'yz', 'zz'))} FROM ({_near_sql(25.0)}) GROUP BY 1""")
def _(pts):
    t1, t2 = epochs(pts)
    m = neighbors.moments_within(t2, t1, 25.0)
    return m.select("source_id", "n", *(F.round(F.col(c) + _NUDGE, 6).alias(c) for c in ("mx", "my", "mz")), *(F.round(F.col(c) + _NUDGE, 5).alias(c) for c in ("xx", "xy", "xz", "yy", "yz", "zz")))


_IJ = ("xx", "xy", "xz", "yy", "yz", "zz")


def _normal_sql(rows: str, keep: str, steps: int = 24) -> str:
    """rows (with their second moments xx to zz and the columns `keep`) and the upward direction nx, ny, nz of least spread.

    The adjugate of the moments has that direction as its leading one; squared again and again, it comes to one of its columns' direction.
    """
    scale = lambda e: {k: f"(({v}) / t)" for k, v in e.items()}
    adj = {"xx": "yy * zz - yz * yz", "xy": "xz * yz - xy * zz", "xz": "xy * yz - xz * yy", "yy": "xx * zz - xz * xz", "yz": "xy * xz - xx * yz", "zz": "xx * yy - xy * xy"}
    square = {"xx": "xx * xx + xy * xy + xz * xz", "xy": "xx * xy + xy * yy + xz * yz", "xz": "xx * xz + xy * yz + xz * zz", "yy": "xy * xy + yy * yy + yz * yz", "yz": "xy * xz + yy * yz + yz * zz", "zz": "xz * xz + yz * yz + zz * zz"}
    sql = f"SELECT {keep}, {', '.join(_IJ)}, xx + yy + zz AS t FROM ({rows})"
    for e in (dict(zip(_IJ, _IJ, strict=True)), adj, *[square] * steps):
        own = f"SELECT {keep}, {', '.join(f'{v} AS {k}' for k, v in scale(e).items())} FROM ({sql})"
        sql = f"SELECT *, xx + yy + zz AS t FROM ({own})"
    big = "CASE WHEN xx >= yy AND xx >= zz THEN {} WHEN yy >= zz THEN {} ELSE {} END"
    v = f"SELECT {keep}, {big.format('xx', 'xy', 'xz')} AS vx, {big.format('xy', 'yy', 'yz')} AS vy, {big.format('xz', 'yz', 'zz')} AS vz FROM ({sql})"
    length = "sqrt(vx * vx + vy * vy + vz * vz) * CASE WHEN vz < 0 THEN -1 ELSE 1 END"
    return f"SELECT {keep}, vx / ({length}) AS nx, vy / ({length}) AS ny, vz / ({length}) AS nz FROM ({v})"


def _plane_sql(pairs: str) -> str:
    """Heights over the planes of pairs (sid, sx .. tz, tid, d2), as vertical_distances() has them."""
    rel = ", ".join(f"avg(t{c} - s{c}) AS m{c}" for c in "xyz")
    cov = ", ".join(f"covar_pop(t{a} - s{a}, t{b} - s{b}) AS {a}{b}" for a, b in _IJ)
    m = f"SELECT sid, arg_min(tid, {{'d': d2, 'i': tid}}) AS tid, {rel}, {cov} FROM ({pairs}) GROUP BY sid HAVING count(*) >= 6"
    n = _normal_sql(m, "sid, tid, mx, my, mz")
    return f"""SELECT s.sid AS source_id, coalesce(p.tid, -1) AS target_id, round(-(mz + (nx * mx + ny * my) / nz), 4) AS distance
FROM (SELECT point_id AS sid FROM pts WHERE epoch = 't2' AND classification = 2) s LEFT JOIN (SELECT * FROM ({n}) WHERE abs(nz) >= 1e-9) p ON s.sid = p.sid"""


@register("vertical_plane_radius", _plane_sql(_near_sql(25.0)))
def _(pts):
    t1, t2 = epochs(pts)
    return cloud_distance.vertical_distances(t2, t1, radius=25.0).withColumn("distance", F.round("distance", 4))


@register("vertical_plane_knn", _plane_sql(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY d2, tid) AS r FROM (SELECT s.*, t.*, {_D2} AS d2 FROM {_PAIRS} ON true)) WHERE r <= 12"))
def _(pts):
    t1, t2 = epochs(pts)
    return cloud_distance.vertical_distances(t2, t1, k=12).withColumn("distance", F.round("distance", 4))


@register("vertical_proxy", f"""SELECT point_id AS core_id, round(b.z - a.z, 6) AS dz FROM (SELECT * FROM pts WHERE classification = 3 AND epoch = 't1') c
JOIN (SELECT sid, arg_min(tz, {{'d': {_D2}, 'i': tid}}) AS z FROM (SELECT point_id AS sid, x AS sx, y AS sy, z AS sz FROM pts WHERE classification = 3 AND epoch = 't1') JOIN (SELECT point_id AS tid, x AS tx, y AS ty, z AS tz FROM pts WHERE classification = 2 AND epoch = 't1') ON tx BETWEEN sx - 20 AND sx + 20 AND ty BETWEEN sy - 20 AND sy + 20 WHERE {_D2} <= 400 GROUP BY 1) a ON a.sid = c.point_id
JOIN (SELECT sid, arg_min(tz, {{'d': {_D2}, 'i': tid}}) AS z FROM (SELECT point_id AS sid, x AS sx, y AS sy, z AS sz FROM pts WHERE classification = 3 AND epoch = 't1') JOIN (SELECT point_id AS tid, x AS tx, y AS ty, z AS tz FROM pts WHERE classification = 2 AND epoch = 't2') ON tx BETWEEN sx - 20 AND sx + 20 AND ty BETWEEN sy - 20 AND sy + 20 WHERE {_D2} <= 400 GROUP BY 1) b ON b.sid = c.point_id""")  # fmt: skip
def _(pts):
    t1, t2 = epochs(pts)
    cores = pts.where("classification = 3 AND epoch = 't1'")
    return r6(vertical_proxy(cores, t1, t2, 20.0), "dz")


def vertical_proxy(cores: DataFrame, t1: DataFrame, t2: DataFrame, reach: float) -> DataFrame:
    """(core_id, dz) of cores with a neighbour in both epochs: the second neighbour's height less the first's."""
    z = [neighbors.nearest_places(neighbors.sources(cores), neighbors.targets(t), reach).select("source_id", F.col("tz").alias(f"z{i}")) for i, t in ((1, t1), (2, t2))]
    return z[0].join(z[1], "source_id").select(F.col("source_id").alias("core_id"), (F.col("z2") - F.col("z1")).alias("dz"))


_RW, _RH = 45, 42


@register("raster_interpolate", f"""SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col, round(coalesce(v, -9999.0::double), 6) AS value FROM range({_RH - 1}) a(r), range({_RW}) b(c) LEFT JOIN (
SELECT r2, c2, arg_min(z, {{'d': d2, 'i': point_id}}) AS v FROM (SELECT r2, c2, z, point_id, (x - (c2 * 25.0::double)) * (x - (c2 * 25.0::double)) + (y - (1000.0::double - r2 * 25.0::double)) * (y - (1000.0::double - r2 * 25.0::double)) AS d2 FROM range({_RH - 1}) e(r2), range({_RW}) f(c2), pts WHERE classification = 2 AND epoch = 't1' AND abs(x - c2 * 25) < 50 AND abs(y - (1000 - r2 * 25)) < 50) WHERE d2 < 2500 GROUP BY 1, 2) ON r = r2 AND c = c2""")  # fmt: skip
def _(pts):
    t1, _ = epochs(pts)
    return r6(raster.interpolate(t1, "z", CELL, EXTENT), "value").select("row", "col", "value")


_UP = """(SELECT point_id AS sid, x AS sx, y AS sy, z AS sz FROM pts WHERE epoch = 't1' AND classification = 2) s JOIN (SELECT epoch, x AS tx, y AS ty, z AS tz FROM pts) t ON tx BETWEEN sx - 2 AND sx + 2 AND ty BETWEEN sy - 2 AND sy + 2 WHERE abs(tz - sz) <= 2 AND (tx - sx) * (tx - sx) + (ty - sy) * (ty - sy) <= 4"""
_UPSQL = f"""SELECT sid AS core_id, CASE WHEN n1 > 0 AND n2 > 0 THEN round(m2 - m1, 6) END AS distance, CASE WHEN n1 > 1 AND n2 > 1 THEN round(1.96 * sqrt(v1 / n1 + v2 / n2), 6) END AS uncertainty, n1, n2 FROM (
SELECT sid, count(*) FILTER (epoch = 't1') AS n1, count(*) FILTER (epoch = 't2') AS n2, avg(tz - sz) FILTER (epoch = 't1') AS m1, avg(tz - sz) FILTER (epoch = 't2') AS m2, var_samp(tz - sz) FILTER (epoch = 't1') AS v1, var_samp(tz - sz) FILTER (epoch = 't2') AS v2 FROM {_UP} GROUP BY 1)"""


def _all(pts: DataFrame) -> tuple[DataFrame, DataFrame]:
    return pts.where("epoch = 't1'"), pts.where("epoch = 't2'")


@register("m3c2_upright", _UPSQL, scale=10.0)
def _(pts):
    t1, t2 = _all(pts)
    return r6(cylinder.compare_upright(filters.filter_classes(t1), t1, t2, PARAMS), "distance", "uncertainty").select("core_id", "distance", "uncertainty", "n1", "n2")


@register("m3c2_stats", f"SELECT count(distance) AS n_valid, round(avg(distance), 5) AS mean, round(median(distance), 5) AS median, round(stddev_pop(distance), 5) AS std, round(sqrt(avg(distance * distance)), 5) AS rmse FROM ({_UPSQL.replace('round(m2 - m1, 6)', 'm2 - m1')})", scale=10.0)
def _(pts):
    t1, t2 = _all(pts)
    got = statistics.change_statistics(cylinder.compare_upright(filters.filter_classes(t1), t1, t2, PARAMS))
    return got.select("n_valid", *(F.round(c, 5).alias(c) for c in ("mean", "median", "std", "rmse")))


def _cylinder_sql() -> str:
    """Cylinders along normals of the first epoch, from the same scales as PARAMS."""
    r, depth, reach = PARAMS.cylinder_radius, PARAMS.max_depth, PARAMS.reach
    cores = "(SELECT point_id AS sid, x AS sx, y AS sy, z AS sz FROM pts WHERE epoch = 't1' AND classification = 2)"
    box = lambda by: f"tx BETWEEN sx - {by!r} AND sx + {by!r} AND ty BETWEEN sy - {by!r} AND sy + {by!r}"
    cov = ", ".join(f"covar_pop(t{a} - s{a}, t{b} - s{b}) AS {a}{b}" for a, b in _IJ)
    scale = PARAMS.projection_scale
    m = f"SELECT sid, sx, sy, sz, {cov} FROM {cores} c JOIN (SELECT x AS tx, y AS ty, z AS tz FROM pts WHERE epoch = 't1') t ON {box(scale)} WHERE {_D2} <= {scale**2!r} GROUP BY ALL HAVING count(*) >= 3"
    n = _normal_sql(m, "sid, sx, sy, sz")
    inside = f"SELECT sid, epoch, (tx - sx) * nx + (ty - sy) * ny + (tz - sz) * nz AS t, {_D2} AS d2 FROM ({n}) c JOIN (SELECT epoch, x AS tx, y AS ty, z AS tz FROM pts) q ON {box(reach)}"
    sums = ", ".join(f"{f}(t) FILTER (epoch = 't{i}') AS {a}{i}" for i in (1, 2) for a, f in (("n", "count"), ("m", "avg"), ("v", "var_samp")))
    got = f"SELECT sid, {sums} FROM ({inside}) WHERE abs(t) <= {depth!r} AND d2 - t * t <= {r**2!r} AND d2 <= {reach**2!r} GROUP BY 1"
    return f"""SELECT c.sid AS core_id, CASE WHEN n1 > 0 AND n2 > 0 THEN round(m2 - m1, 5) END AS distance, CASE WHEN n1 > 1 AND n2 > 1 THEN round(1.96 * sqrt(v1 / n1 + v2 / n2), 5) END AS uncertainty, coalesce(n1, 0) AS n1, coalesce(n2, 0) AS n2
FROM {cores} c LEFT JOIN ({got}) g ON c.sid = g.sid"""


@register("m3c2_full", _cylinder_sql(), scale=10.0)
def _(pts):
    t1, t2 = _all(pts)
    got = cylinder.compare(filters.filter_classes(t1), t1, t2, PARAMS)
    return got.select("core_id", F.round("distance", 5).alias("distance"), F.round("uncertainty", 5).alias("uncertainty"), "n1", "n2")


@register("m3c2_autotune", "SELECT n, round(r, 6) AS radius, round(greatest(0.5, 0.6 * r), 6) AS max_depth, 8 AS min_neighbors FROM (SELECT count(*) AS n, least(20.0::double, greatest(1.0::double, sqrt(16 / (pi() * count(*) / greatest(1e-6, (max(x) - min(x)) * (max(y) - min(y))))))) AS r FROM pts WHERE classification = 2)")
def _(pts):
    ground = filters.filter_classes(pts)
    p = cylinder.autotune(ground)
    return ground.agg(F.count(F.lit(1)).alias("n")).select("n", F.round(F.lit(p.cylinder_radius), 6).alias("radius"), F.round(F.lit(p.max_depth), 6).alias("max_depth"), F.lit(p.min_neighbors).alias("min_neighbors"))


_GRID = _dod_sql(_MEAN).replace("round(b.v - a.v, 6)", "b.v - a.v").replace("round(a.v, 6)", "a.v").replace("round(b.v, 6)", "b.v")


def _grid(pts: DataFrame) -> DataFrame:
    return grid.dod(*epochs(pts), cell=CELL, b=EXTENT)


@register("distance_histogram", f"SELECT bin, count(*) AS n, -60.0::double + (bin - 0.5::double) * 2.0::double AS centre FROM (SELECT CAST(least(60, floor((round(dod, 6) + 60) / 2.0::double) + 1) AS INT) AS bin FROM ({_GRID}) WHERE round(dod, 6) BETWEEN -60 AND 60) GROUP BY 1")
def _(pts):
    return statistics.histogram(r6(_grid(pts), "dod"), "dod", -60.0, 60.0, 60)


@register("sign_summary", f"SELECT count(dod) AS n, round(100.0::double * count(*) FILTER (dod > 0) / count(*), 6) AS percent_positive, round(100.0::double * count(*) FILTER (dod < 0) / count(*), 6) AS percent_negative, round(median(dod), 6) AS median, round(quantile_cont(dod, 0.05), 6) AS p5, round(quantile_cont(dod, 0.95), 6) AS p95, round(quantile_cont(abs(dod), 0.95), 6) AS p95_abs FROM (SELECT round(dod, 6) AS dod FROM ({_GRID}))")
def _(pts):
    return r6(statistics.sign_summary(r6(_grid(pts), "dod"), "dod"), "percent_positive", "percent_negative", "median", "p5", "p95", "p95_abs")


@register("pearson", f"SELECT count(*) AS n, round(corr(dem1, dem2), 6) AS r FROM ({_GRID})")
def _(pts):
    return r6(statistics.pearson(_grid(pts), "dem1", "dem2"), "r")


@register("distance_report", f"""SELECT count(d) AS count, min(d) AS min, max(d) AS max, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS std, round(median(d), 6) AS median, round(quantile_cont(d, 0.05), 6) AS p5, round(quantile_cont(d, 0.95), 6) AS p95, count(*) FILTER (d > l) AS significant, round(100.0::double * count(*) FILTER (d > l) / count(*), 6) AS percent_significant
FROM (SELECT d, avg(d) OVER () + 2 * stddev_pop(d) OVER () AS l FROM (SELECT round(dod, 6) AS d FROM ({_GRID})))""")  # fmt: skip
def _(pts):
    return r6(statistics.distance_report(r6(_grid(pts), "dod"), "dod"), "mean", "std", "median", "p5", "p95", "percent_significant")


@register("centroid", "SELECT epoch, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y, round(avg(z), 6) AS mean_z FROM pts GROUP BY 1")
def _(pts):
    both = [statistics.centroid(pts.where(F.col("epoch") == e)).withColumn("epoch", F.lit(e)) for e in ("t1", "t2")]
    return r6(both[0].unionByName(both[1]), "mean_x", "mean_y", "mean_z")


@register("centroid_transform", "SELECT point_id, round(x + (SELECT avg(x) FILTER (epoch = 't1') - avg(x) FILTER (epoch = 't2') FROM pts), 5) AS x, round(y + (SELECT avg(y) FILTER (epoch = 't1') - avg(y) FILTER (epoch = 't2') FROM pts), 5) AS y, round(z + (SELECT avg(z) FILTER (epoch = 't1') - avg(z) FILTER (epoch = 't2') FROM pts), 5) AS z FROM pts WHERE epoch = 't2'")
def _(pts):
    t1, t2 = _all(pts)
    return apply_transform(t2, registration.centroid_transform(t2, t1)).select("point_id", *(F.round(c, 5).alias(c) for c in "xyz"))


@register("covariance3", f"SELECT {', '.join(f'round(covar_pop({a}, {b}), 4) AS cov_{a}{b}' for a, b in ('xx', 'xy', 'xz', 'yy', 'yz', 'zz'))} FROM pts")
def _(pts):
    c = statistics.covariance(pts)
    return c.select(*(F.round(x, 4).alias(x) for x in c.columns))


@register("density", "SELECT count(*) AS n, round((max(x) - min(x)) * (max(y) - min(y)), 4) AS area, round(count(*) / ((max(x) - min(x)) * (max(y) - min(y))), 8) AS density FROM pts")
def _(pts):
    return statistics.density(pts).select("n", F.round("area", 4).alias("area"), F.round("density", 8).alias("density"))


_MATCH = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY d2, tid) AS r FROM ({_near_sql(8.0)})) WHERE r = 1 AND sqrt(d2) < 8"


@register("kabsch_sums", f"SELECT count(*) AS n, {', '.join(f'round(avg({s}{c}), 5) AS m{s}{c}' for s in 'st' for c in 'xyz')}, {', '.join(f'round(covar_pop(s{a}, t{b}), 3) AS h{a}{b}' for a in 'xyz' for b in 'xyz')} FROM ({_MATCH})")
def _(pts):
    t1, t2 = epochs(pts)
    got = registration.pair_sums(registration.matched(t2, t1, 8.0))
    return got.select("n", *(F.round(c, 5 if c[0] == "m" else 3).alias(c) for c in got.columns if c != "n"))


@register("pair_distances", f"SELECT sid AS source_id, round(sqrt(d2), 6) AS distance FROM ({_MATCH})")
def _(pts):
    t1, t2 = epochs(pts)
    got = registration.matched(t2, t1, 8.0)
    return got.select("source_id", F.round(distance(("sx", "sy", "sz"), ("tx", "ty", "tz")), 6).alias("distance"))


@register("icp_rmse", f"SELECT round(sqrt(avg(d2)), 6) AS rmse FROM ({_MATCH})")
def _(pts):
    t1, t2 = epochs(pts)
    rmse = registration.registration_error(t2, t1, 8.0)
    return pts.sparkSession.range(1).select(F.round(F.lit(rmse), 6).alias("rmse"))


def _matrix_rows(spark: SparkSession, m, digits: int, **more: float) -> DataFrame:
    rows = [(i, *(round(float(v), digits) + 0.0 for v in r), *(round(float(v), digits) + 0.0 for v in more.values())) for i, r in enumerate(m)]
    return spark.createDataFrame(rows, ", ".join(["row int", *(f"c{j} double" for j in range(4)), *(f"{k} double" for k in more)]))


def _matrix_sql(m, digits: int, more: str = "") -> str:
    """The rows of a matrix; more: further columns."""
    rows = ", ".join(f"({i}, {', '.join(f'{round(float(v), digits) + 0.0!r}::double' for v in r)})" for i, r in enumerate(m))
    return f"SELECT CAST(r AS INT) AS row, c0, c1, c2, c3{more} FROM (VALUES {rows}) v(r, c0, c1, c2, c3)"


_BACK = np.linalg.inv(np.array(RIGID))


@register("icp_align", _matrix_sql(_BACK, 5, ", 0.0::double AS rmse"))
def _(pts):
    t1, _ = epochs(pts)
    got = registration.icp(apply_transform(t1, RIGID), t1, reach=30.0)  # until it converges: 8 iterations did for small clouds only
    return _matrix_rows(pts.sparkSession, got.matrix, 5, rmse=got.rmse)


@register("coarse_pca", _matrix_sql(_BACK, 5))
def _(pts):
    t1, _ = epochs(pts)
    return _matrix_rows(pts.sparkSession, registration.axes_transform(apply_transform(t1, RIGID), t1), 5)


@register("coarse_phase", _matrix_sql(SHIFT, 1))
def _(pts):
    t1, _ = epochs(pts)
    return _matrix_rows(pts.sparkSession, registration.phase_transform(t1, apply_transform(t1, SHIFT), 5.0), 1)


@register("core_sample", "SELECT point_id, x, y, z FROM pts WHERE classification = 2 ORDER BY md5(point_id::varchar || ':0'), point_id LIMIT 500")
def _(pts):
    return sampling.sample(filters.filter_classes(pts), 500).select("point_id", *"xyz")


@register("core_percent", "SELECT point_id FROM (SELECT point_id, row_number() OVER (ORDER BY md5(point_id::varchar || ':3'), point_id) AS r, count(*) OVER () AS n FROM pts WHERE classification = 2) WHERE r <= greatest(1, floor(n * 10.0 / 100.0))")
def _(pts):
    return sampling.core_points(filters.filter_classes(pts), 10.0, seed=3).select("point_id")


@register("sample_per_class", "SELECT point_id, classification FROM (SELECT *, row_number() OVER (PARTITION BY classification ORDER BY md5(point_id::varchar || ':0'), point_id) AS r FROM pts) WHERE r <= 100")
def _(pts):
    return sampling.sample_per(pts, ["classification"], 100).select("point_id", "classification")


@register("percent_per_tile", f"SELECT point_id, tile_i, tile_j FROM (SELECT *, row_number() OVER (PARTITION BY tile_i, tile_j ORDER BY md5(point_id::varchar || ':0'), point_id) AS r, count(*) OVER (PARTITION BY tile_i, tile_j) AS n FROM (SELECT *, {_TI} AS tile_i, {_TJ} AS tile_j FROM pts)) WHERE r <= greatest(1, floor(n * 0.1::double))")
def _(pts):
    return sampling.percent_per(grid.tile_of(pts, EXTENT, 90.0), ["tile_i", "tile_j"], 10.0).select("point_id", "tile_i", "tile_j")


def order_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as surveys: an area for each priority, a period for each year."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(
        F.col("o_orderpriority").alias("area"), F.year("o_orderdate").cast("string").alias("time_period"), F.concat_ws("/", "o_orderpriority", F.year("o_orderdate").cast("string"), "o_orderstatus").alias("file"),
        F.col("o_orderkey").cast("double").alias("x"), F.col("o_custkey").cast("double").alias("y"), F.col("o_totalprice").alias("z"), (F.col("o_orderkey") % 4).cast("int").alias("classification"))


_ORDERS = "(SELECT o_orderpriority AS area, year(o_orderdate)::varchar AS time_period, o_orderpriority || '/' || year(o_orderdate) || '/' || o_orderstatus AS file, o_orderkey::double AS x, o_custkey::double AS y, o_totalprice AS z, CAST(o_orderkey % 4 AS INT) AS classification FROM orders)"


@register("catalog_rollup", f"SELECT area, time_period, count(*) AS n_points, count(*) FILTER (classification = 2) AS n_ground, {', '.join(f'{f}({c}) AS {f}_{c}' for c in 'xyz' for f in ('min', 'max'))}, round(100.0::double * count(*) FILTER (classification = 2) / count(*), 6) AS ground_percent FROM {_ORDERS} GROUP BY 1, 2", points=False)
def _(spark, sf_dir):
    return r6(statistics.catalog_rollup(order_points(spark, sf_dir)), "ground_percent")


@register("epoch_pairs", f"WITH c AS (SELECT DISTINCT area, time_period FROM {_ORDERS}) SELECT a.area, a.time_period AS first, b.time_period AS second FROM c a JOIN c b ON a.area = b.area AND a.time_period < b.time_period", points=False)
def _(spark, sf_dir):
    return statistics.epoch_pairs(order_points(spark, sf_dir))


@register("first_periods", f"SELECT area, time_period, CAST(r AS INT) AS rank FROM (SELECT area, time_period, row_number() OVER (PARTITION BY area ORDER BY time_period) AS r FROM (SELECT DISTINCT area, time_period FROM {_ORDERS} WHERE time_period LIKE '%199%')) WHERE r <= 2", points=False)
def _(spark, sf_dir):
    return filters.first_periods(order_points(spark, sf_dir), ["199"])


@register("areas_with_change", f"SELECT area, count(DISTINCT time_period) AS periods FROM {_ORDERS} GROUP BY 1 HAVING count(DISTINCT time_period) >= 2", points=False)
def _(spark, sf_dir):
    return filters.areas_with_change(order_points(spark, sf_dir))


@register("file_metadata", f"SELECT file, count(*) AS n_points, count(*) FILTER (classification = 2) AS n_ground, min(z) AS min_z, max(z) AS max_z, round(coalesce(avg(z) FILTER (classification = 2), avg(z)), 4) AS mean_z, round(coalesce(stddev_pop(z) FILTER (classification = 2), stddev_pop(z)), 4) AS std_z, round(100.0::double * count(*) FILTER (classification = 2) / count(*), 6) AS ground_percent, count(DISTINCT classification) AS n_classes FROM {_ORDERS} GROUP BY 1", points=False)
def _(spark, sf_dir):
    m = statistics.file_metadata(order_points(spark, sf_dir))
    return r6(m, "ground_percent").select("file", "n_points", "n_ground", "min_z", "max_z", F.round("mean_z", 4).alias("mean_z"), F.round("std_z", 4).alias("std_z"), "ground_percent", F.size("classes").cast("long").alias("n_classes"))


@register("file_validity", f"SELECT file, count(*) AS n, true AS valid FROM {_ORDERS} GROUP BY 1", points=False)
def _(spark, sf_dir):
    return statistics.file_validity(order_points(spark, sf_dir))


def _synthetic_sql(seed: int, bumps: str) -> str:
    u = lambda i: f"((('0x' || substr(md5(id || ':{seed}:{i}'), 1, 13))::BIGINT::DOUBLE + 0.5) / {float(1 << 52)!r}::DOUBLE)"
    return f"""(SELECT x, y, 10 + 2 * sin(x / 35) + 1.5::DOUBLE * cos(y / 27) + 0.01::DOUBLE * x {bumps} + 0.02::DOUBLE * sqrt(-2 * ln({u(0)})) * cos(2 * pi() * {u(1)}) AS z
FROM (SELECT id, (id % 200 - 100)::DOUBLE AS x, (id // 200 - 100)::DOUBLE AS y FROM range(40000) r(id)) WHERE {u(2)} < 0.25::DOUBLE)"""


_BUMPS = "+ 0.6::DOUBLE * exp(-((x + 50) * (x + 50) + (y - 60) * (y - 60)) / 1250) - 0.5::DOUBLE * exp(-((x - 40) * (x - 40) + (y + 30) * (y + 30)) / 800)"


@register("synthetic_change", f"""WITH a AS {_synthetic_sql(1, "")}, b AS {_synthetic_sql(2, _BUMPS)}, o AS (SELECT min(x) AS x0, min(y) AS y0 FROM (SELECT x, y FROM a UNION ALL SELECT x, y FROM b))
SELECT p.cx AS cell_x, p.cy AS cell_y, round(p.v, 6) AS dem1, round(q.v, 6) AS dem2, round(q.v - p.v, 6) AS dod
FROM (SELECT CAST(floor((x - x0) / 10) AS INT) AS cx, CAST(floor((y - y0) / 10) AS INT) AS cy, avg(z) AS v FROM a, o GROUP BY 1, 2) p
JOIN (SELECT CAST(floor((x - x0) / 10) AS INT) AS cx, CAST(floor((y - y0) / 10) AS INT) AS cy, avg(z) AS v FROM b, o GROUP BY 1, 2) q ON p.cx = q.cx AND p.cy = q.cy""", points=False)  # fmt: skip
def _(spark, sf_dir):
    a = synthetic(spark, 200, 200, epoch="t1", seed=1)
    b = synthetic(spark, 200, 200, epoch="t2", seed=2, features=[("mound", 0.6, -50, 60, 25), ("pit", 0.5, 40, -30, 20)])
    return r6(grid.dod(a, b, cell=10.0), "dem1", "dem2", "dod")


_SELF = f"SELECT sid, d2, tid FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY d2, tid) AS r FROM (SELECT s.*, t.*, {_D2} AS d2 FROM {_PAIRS.replace(chr(39) + 't2' + chr(39), chr(39) + 't1' + chr(39))} ON true)) WHERE r <= 7"


@register("outlier_removal", f"WITH m AS (SELECT sid, sum(sqrt(d2)) / 6 AS d FROM ({_SELF}) GROUP BY 1) SELECT sid AS point_id, round(d, 6) AS mean_distance FROM m WHERE d <= (SELECT avg(d) + 1.0 * stddev_pop(d) FROM m)".replace("WITH m AS", ", m AS", 1))
def _(pts):
    t1, _ = epochs(pts)
    return r6(thinning.without_outliers(t1, 6, 1.0), "mean_distance").select("point_id", "mean_distance")


@register("spatial_thinning", "SELECT point_id FROM (SELECT point_id, row_number() OVER (PARTITION BY floor(x / 20), floor(y / 20), floor(z / 20) ORDER BY point_id) AS r FROM pts) WHERE r = 1")
def _(pts):
    return thinning.one_per_voxel(pts, 20.0).select("point_id")


from stratamesh.plans import registry_files  # noqa: E402, F401  it registers its queries here
