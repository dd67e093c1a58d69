"""More registered queries: sources and sinks by a round trip through files, and operators put together."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamesh.functions.geometry import Bounds
from stratamesh.operators import cylinder, filters, grid, neighbors, quadtree, registration, sampling, thinning
from stratamesh.operators.clip import ClipArea, clip
from stratamesh.operators.estimator import NearestNeighbors
from stratamesh.operators.point_index import held_at_most
from stratamesh.operators.transforms import LocalFrame, apply_transform, local_frame, matrix_from_text, matrix_to_text
from stratamesh.plans.config import Settings, parse_settings
from stratamesh.plans.facade import ChangeDetector
from stratamesh.plans.registry import _BACK, _CX, _CY, _D2, _IJ, _MATCH, _NEAREST, _PAIRS, _TI, _TJ, CELL, EXTENT, FRAME, HOLED, INNER, ORACLES, PARAMS, QUERIES, REACH, RIGID, TRIANGLE, TURN, _cylinder_sql, _dod_sql, _matrix_rows, _matrix_sql, _moved_sql, _near_sql, _normal_sql, _turned, epochs, r6, register
from stratamesh.plans.workflow import compare_epochs
from stratamesh.sources import las, layout, points, rasters, sinks
from stratamesh.staging import mounted, stage_path
from stratamesh.streaming.elevation import arriving_points, running_dod

def _body(name: str) -> str:
    """A registered query's SQL without the definition of pts."""
    return ORACLES[name].removeprefix(f"WITH pts AS ({points.lineitem_points_sql()})\n")


_BOX = "x BETWEEN 200.0::double AND 820.0::double AND y BETWEEN 150.0::double AND 777.0::double"
_XYZ4 = ", ".join(f"round({c}, 4) AS {c}" for c in "xyz")


def _las(pts: DataFrame, **options) -> tuple[SparkSession, str]:
    spark, folder = pts.sparkSession, mounted(stage_path(pts.sparkSession, "las"))
    las.register(spark)
    las.write(pts, folder, scale=0.0001, **options)
    return spark, folder


@register("las_round_trip", f"SELECT {_XYZ4}, classification, round(z / 3, 9) AS third, 1 - classification % 2 AS even FROM pts")
def _(pts):
    spark, folder = _las(pts.withColumns({"distance": F.round(F.col("z") / 3, 9), "even": F.col("classification") % 2 == 0}))
    got = spark.read.format("las").load(folder)
    return got.select(*(F.round(c, 4).alias(c) for c in "xyz"), "classification", F.col("distance").alias("third"), (1 - F.col("classification") % 2).alias("even"))


@register("las_filtered", f"SELECT {_XYZ4} FROM pts WHERE classification IN (2, 5) AND {_BOX}")
def _(pts):
    spark, folder = _las(pts)
    got = filters.filter_box(filters.filter_classes(spark.read.format("las").load(folder), classes=[2, 5]), INNER)
    return got.select(*(F.round(c, 4).alias(c) for c in "xyz"))


@register("las_any_store", "SELECT classification, count(*) AS n, round(sum(z), 3) AS height FROM pts GROUP BY 1")
def _(pts):
    spark, folder = _las(pts)
    return las.read_anywhere(spark, folder).groupBy("classification").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("z"), 3).alias("height"))


@register("las_headers", f"SELECT CAST(sum(n) AS BIGINT) AS n_points, {', '.join(f'round({f}({c}), 4) AS {f}_{c}' for c in 'xyz' for f in ('min', 'max'))}, '1.4' AS version, CAST(6 AS INT) AS point_format, 'PROJCS' AS crs FROM (SELECT 1 AS n, x, y, z FROM pts)")
def _(pts):
    spark, folder = _las(pts, wkt=sinks.wkt_of(25833))
    paths = sorted(str(r[0]).removeprefix("file:") for r in spark.read.format("binaryFile").load(folder).select("path").collect())
    heads = las.headers(spark, paths)
    crs = las.wkt_in(paths[0])[:6]
    return heads.groupBy("version", "point_format").agg(F.sum("n_points").alias("n_points"), *(F.round(f(f"{n}_{c}"), 4).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max)))).withColumn("crs", F.lit(crs))


@register("dataset_scan", f"SELECT epoch, point_id, x, y, z FROM pts WHERE classification = 2 AND {_BOX}")
def _(pts):
    path = stage_path(pts.sparkSession, "scan")
    pts.write.parquet(path)
    return points.scan_points(pts.sparkSession, path, box=INNER, columns=("epoch", "point_id", "x", "y", "z"))


def _catalog(pts: DataFrame) -> tuple[SparkSession, DataFrame]:
    """Points in folders area/period/data, found again."""
    base = stage_path(pts.sparkSession, "areas")
    for area, cond in (("even", "classification % 2 = 0"), ("odd", "classification % 2 = 1")):
        for period in ("t1", "t2"):
            own = pts.where(cond).where(F.col("epoch") == period).drop("epoch")
            (own.drop("classification") if area == "odd" else own).write.parquet(f"{base}/{area}/{period}/data")
    return pts.sparkSession, points.discover(pts.sparkSession, base)


_AREA = "CASE WHEN classification % 2 = 0 THEN 'even' ELSE 'odd' END"


@register("discovered_areas", f"SELECT {_AREA} AS area, epoch AS time_period FROM pts GROUP BY 1, 2")
def _(pts):
    return _catalog(pts)[1].select("area", "time_period").distinct()


@register("loaded_dataset", f"SELECT {_AREA} AS area, epoch AS time_period, count(*) AS n, round(sum(z), 4) AS height, count(*) FILTER (classification % 2 = 0) AS classed FROM pts GROUP BY 1, 2")
def _(pts):
    spark, catalog = _catalog(pts)
    got = points.load_dataset(spark, catalog)
    return got.groupBy("area", "time_period").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("z"), 4).alias("height"), F.count("classification").alias("classed"))


@register("clip_geojson", f"SELECT point_id FROM pts WHERE {HOLED.sql()}")
def _(pts):
    path = stage_path(pts.sparkSession, "boundary.geojson")
    sinks.write_text(pts.sparkSession, path, HOLED.to_geojson())
    return clip(pts, ClipArea.from_geojson(sinks.read_text(pts.sparkSession, path))).select("point_id")


@register("clip_shapefile", f"SELECT point_id FROM pts WHERE {HOLED.sql()}")
def _(pts):
    spark, path = pts.sparkSession, stage_path(pts.sparkSession, "boundary.shp")
    sinks.write_bytes(spark, path, HOLED.to_shapefile())
    content = spark.read.format("binaryFile").load(path).select("content").first()[0]
    return clip(pts, ClipArea.from_shapefile(bytes(content))).select("point_id")


@register("clip_local_frame", f"SELECT point_id FROM pts WHERE {TRIANGLE.sql()}")
def _(pts):
    moved = FRAME.to_local(pts)
    return clip(moved, TRIANGLE.shifted(-FRAME.offset_x, -FRAME.offset_y)).select("point_id")


@register("clip_to_files", f"SELECT CAST(classification AS INT) AS file, count(*) AS n FROM pts WHERE {TRIANGLE.sql()} GROUP BY 1")
def _(pts):
    path = stage_path(pts.sparkSession, "clipped")
    sinks.clip_files(pts.withColumn("file", F.col("classification")), TRIANGLE, path)
    return pts.sparkSession.read.parquet(path).groupBy("file").agg(F.count(F.lit(1)).alias("n"))


@register("transform_to_files", f"SELECT point_id, {_moved_sql(TURN)}, classification || '_aligned' AS file FROM pts")
def _(pts):
    spark, path, text = pts.sparkSession, stage_path(pts.sparkSession, "moved"), stage_path(pts.sparkSession, "matrix.txt")
    sinks.write_text(spark, text, matrix_to_text(TURN))
    sinks.transform_files(pts.withColumn("file", F.col("classification").cast("string")), matrix_from_text(sinks.read_text(spark, text)), path)
    return spark.read.parquet(path).select("point_id", *(F.round(c, 8).alias(c) for c in "xyz"), "file")


@register("points_to_files", "SELECT point_id, round(x, 6) AS x, round(y, 6) AS y, classification = 2 AS ground FROM pts")
def _(pts):
    path = stage_path(pts.sparkSession, "points")
    sinks.write_points(FRAME.to_local(pts).withColumn("ground", F.col("classification") == 2), path, FRAME, by="epoch")
    return pts.sparkSession.read.parquet(path).select("point_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), (F.col("ground") == 1).alias("ground"))


@register("raster_files", _dod_sql("avg(z)").replace("SELECT coalesce", "SELECT cell_x, cell_y, round(CAST(dod AS FLOAT)::double, 3) AS dod FROM (SELECT coalesce") + ")")
def _(pts):
    spark, folder = pts.sparkSession, mounted(stage_path(pts.sparkSession, "rasters"))
    rasters.write_rasters(r6(grid.dod(*epochs(pts), cell=CELL, b=EXTENT), "dod"), "dod", EXTENT, CELL, folder, 25833, side=16).collect()  # a row for each file
    return rasters.read_rasters(spark, folder, EXTENT, CELL).select("cell_x", "cell_y", F.round("value", 3).alias("dod"))


@register("histogram_file", _body("distance_histogram").replace("SELECT bin, count(*) AS n, -60.0::double + (bin - 0.5::double) * 2.0::double AS centre", "SELECT bin, count(*) AS value, -62.0::double + bin * 2.0::double AS bin_start, -60.0::double + bin * 2.0::double AS bin_end, -61.0::double + bin * 2.0::double AS centre"))
def _(pts):
    from stratamesh.operators import statistics

    path = stage_path(pts.sparkSession, "histogram")
    h = statistics.histogram(r6(grid.dod(*epochs(pts), cell=CELL, b=EXTENT), "dod"), "dod", -60.0, 60.0, 60)
    h.select("bin", F.col("n").alias("value"), (F.col("centre") - 1).alias("bin_start"), (F.col("centre") + 1).alias("bin_end")).write.option("sep", ";").option("header", True).csv(path)
    return points.histogram_csv(pts.sparkSession, path)


@register("distance_fallback", "SELECT point_id, z AS distance FROM pts")
def _(pts):
    return points.distance_column(pts.select("point_id", "x", "y", F.col("z").alias("m3c2_distance"))).select("point_id", "distance")


@register("crs_codes", "SELECT CAST(n_nationkey AS INT) AS key, CAST(25800 + n_nationkey AS INT) AS epsg FROM nation", points=False)
def _(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    code = (F.col("n_nationkey") + 25800).cast("string")
    old = F.concat(F.lit('PROJCS["a",GEOGCS["g",AUTHORITY["EPSG","4258"]],AUTHORITY["EPSG","'), code, F.lit('"]]'))
    new = F.concat(F.lit('PROJCRS["a",ID["EPSG",'), code, F.lit("]]"))
    return n.select(F.col("n_nationkey").cast("int").alias("key"), points.epsg_of(F.when(F.col("n_nationkey") % 2 == 0, old).otherwise(new)).alias("epsg"))


@register("finite_filter", "SELECT point_id FROM pts WHERE classification NOT IN (1, 2, 3)")
def _(pts):
    odd = F.when(F.col("classification") == 1, F.lit(None)).when(F.col("classification") == 2, F.lit(float("nan"))).when(F.col("classification") == 3, F.lit(float("inf"))).otherwise(F.col("z"))
    return filters.filter_finite(pts.withColumn("z", odd), "z").select("point_id")


@register("local_frame_first", "SELECT point_id, round(x - (SELECT arg_min(x, point_id) FROM pts), 6) AS x, round(y - (SELECT arg_min(y, point_id) FROM pts), 6) AS y, round(z - (SELECT arg_min(z, point_id) FROM pts), 6) AS z FROM pts")
def _(pts):
    return r6(local_frame(pts, "first_point", include_z=True).to_local(pts), *"xyz").select("point_id", *"xyz")


@register("frame_round_trip", "SELECT round(min(x) - 466.25, 6) AS min_x, round(min(y) - 50.5, 6) AS min_y, round(max(x) - 466.25, 6) AS max_x, round(max(y) - 50.5, 6) AS max_y FROM pts")
def _(pts):
    frame = LocalFrame.from_json(FRAME.to_json())
    b = frame.bounds_to_local(grid.bounds_of(pts))
    assert frame.bounds_to_local(frame.bounds_to_global(b)) == b
    return pts.sparkSession.createDataFrame([tuple(round(v, 6) for v in (b.min_x, b.min_y, b.max_x, b.max_y))], "min_x double, min_y double, max_x double, max_y double")


@register("m3c2_autotune_headers", "SELECT round(r, 6) AS radius, round(greatest(0.5, 0.6 * r), 6) AS max_depth, 8 AS min_neighbors FROM (SELECT least(20.0::double, greatest(1.0::double, sqrt(16 / (pi() * count(*) FILTER (epoch = 't1') / greatest(1e-6, (max(x) - min(x)) * (max(y) - min(y))))))) AS r FROM pts)")
def _(pts):
    heads = points.file_bounds(pts.withColumnRenamed("epoch", "file")).withColumnRenamed("file", "epoch")
    p = cylinder.autotune_headers(heads)
    return pts.sparkSession.createDataFrame([(round(p.cylinder_radius, 6), round(p.max_depth, 6), p.min_neighbors)], "radius double, max_depth double, min_neighbors int")


@register("coarse_checked", _matrix_sql(_BACK, 5))
def _(pts):
    t1, _ = epochs(pts)
    return _matrix_rows(pts.sparkSession, registration.coarse(apply_transform(t1, RIGID), t1, "pca"), 5)


@register("icp_multiscale", _matrix_sql(_BACK, 5, ", 0.0::double AS rmse"))
def _(pts):
    t1, _ = epochs(pts)
    got = registration.multiscale_icp(apply_transform(t1, RIGID), t1, coarse_reach=30.0, coarse_iterations=8, reach=10.0, iterations=8)
    return _matrix_rows(pts.sparkSession, got.matrix, 5, rmse=got.rmse)


_TILES = f"(300.0::double * floor(x / 300) <= {INNER.max_x} AND 300.0::double * floor(x / 300) + 300 >= {INNER.min_x} AND 300.0::double * floor(y / 300) <= {INNER.max_y} AND 300.0::double * floor(y / 300) + 300 >= {INNER.min_y})"
_SMALL = Bounds(0.0, 0.0, 110.0, 100.0)
_LOW = Bounds(20.0, 15.0, 62.0, 58.0)


@register("tiles_in_area", f"SELECT point_id, CAST(least(3, greatest(0, floor(x / 300))) AS INT) AS tile_i, CAST(least(3, greatest(0, floor(y / 300))) AS INT) AS tile_j FROM pts WHERE {_TILES.replace('floor(x / 300)', 'least(3, greatest(0, floor(x / 300)))').replace('floor(y / 300)', 'least(3, greatest(0, floor(y / 300)))')}")
def _(pts):
    return grid.in_tiles_meeting(pts, EXTENT, 300.0, INNER).select("point_id", "tile_i", "tile_j")


@register("c2c_in_area", f"SELECT n.source_id, n.target_id, n.distance FROM ({_NEAREST}) n JOIN pts p ON p.point_id = n.source_id WHERE {_TILES.replace('floor(x / 300)', 'least(3, greatest(0, floor(x / 300)))').replace('floor(y / 300)', 'least(3, greatest(0, floor(y / 300)))')}")
def _(pts):
    t1, t2 = epochs(pts)
    return r6(neighbors.nearest_within(grid.in_tiles_meeting(t2, EXTENT, 300.0, INNER), t1, REACH), "distance")


@register("tile_functions", f"SELECT {_TI} AS tile_i, {_TJ} AS tile_j, count(*) AS n_inner, round(avg(z), 6) AS mean_z FROM pts WHERE classification = 2 GROUP BY 1, 2")
def _(pts):
    def work(inner: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        assert len(outer) >= len(inner)
        return pd.DataFrame({"n_inner": [len(inner)], "mean_z": [inner.z.mean()]})

    return r6(grid.map_tiles(filters.filter_classes(pts).select("point_id", *"xyz"), EXTENT, 90.0, 20.0, work, "n_inner long, mean_z double"), "mean_z").select("tile_i", "tile_j", "n_inner", "mean_z")


def _tiled_cylinders() -> str:
    tile = lambda c, n: f"CAST(greatest(0, least({n - 1}, floor({c} / 25.0::double))) AS INT)"
    meets = " AND ".join(f"25.0::double * {t} <= {hi!r} AND 25.0::double * ({t} + 1) >= {lo!r}" for t, lo, hi in (("tile_i", _LOW.min_x, _LOW.max_x), ("tile_j", _LOW.min_y, _LOW.max_y)))
    picked = f"""SELECT point_id, tile_i, tile_j FROM (SELECT *, row_number() OVER (PARTITION BY tile_i, tile_j ORDER BY md5(point_id::varchar || ':0'), point_id) AS r, count(*) OVER (PARTITION BY tile_i, tile_j) AS n
FROM (SELECT *, {tile('x', 5)} AS tile_i, {tile('y', 4)} AS tile_j FROM pts WHERE epoch = 't1' AND classification = 2)) WHERE r <= greatest(1, floor(n * 0.2::double)) AND {meets}"""
    return f"SELECT g.*, k.tile_i, k.tile_j FROM ({_cylinder_sql()}) g JOIN ({picked}) k ON k.point_id = g.core_id"


@register("m3c2_tiles", _tiled_cylinders(), scale=10.0)
def _(pts):
    t1, t2 = pts.where("epoch = 't1'"), pts.where("epoch = 't2'")
    got = cylinder.compare_tiles(t1, t2, _SMALL, 25.0, 20.0, PARAMS, _LOW, cores_of=filters.filter_classes(t1))
    return got.select("core_id", F.round("distance", 5).alias("distance"), F.round("uncertainty", 5).alias("uncertainty"), "n1", "n2", "tile_i", "tile_j")


@register("normals", f"SELECT sid AS source_id, round(nx, 5) + 0.0::double AS nx, round(ny, 5) + 0.0::double AS ny, round(nz, 5) AS nz FROM ({_normal_sql('SELECT sid, ' + ', '.join(f'covar_pop(t{a} - s{a}, t{b} - s{b}) AS {a}{b}' for a, b in _IJ) + f' FROM ({_near_sql(70.0)}) GROUP BY 1 HAVING count(*) >= 5', 'sid')})")
def _(pts):
    t1, t2 = epochs(pts)
    got = cylinder.normals(t2, t1, 70.0, 5)
    return got.select("source_id", *((F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("nx", "ny")), F.round("nz", 5).alias("nz"))


@register("octree_thinning", """SELECT point_id FROM (SELECT point_id, row_number() OVER (PARTITION BY i, j, k ORDER BY (x - (i + 0.5::double) * 35.0::double) * (x - (i + 0.5::double) * 35.0::double) + (y + 560.0::double - (j + 0.5::double) * 35.0::double) * (y + 560.0::double - (j + 0.5::double) * 35.0::double) + (z - (k + 0.5::double) * 35.0::double) * (z - (k + 0.5::double) * 35.0::double), point_id) AS r
FROM (SELECT *, least(63, floor(x / 35.0::double)) AS i, least(63, floor((y + 560.0::double) / 35.0::double)) AS j, least(63, floor(z / 35.0::double)) AS k FROM pts)) WHERE r = 1""")  # fmt: skip
def _(pts):
    return thinning.octree(pts, 6, (0.0, -560.0, 0.0), 2240.0).select("point_id")


@register("random_thinning", "SELECT point_id FROM pts ORDER BY md5(point_id::varchar || ':5'), point_id LIMIT 700")
def _(pts):
    return thinning.random_share(pts, 700, seed=5).select("point_id")


_KNN3 = f"SELECT sid AS source_id, tid AS target_id, round(sqrt(d2), 6) AS distance, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY d2, tid) AS r FROM (SELECT s.*, t.*, {_D2} AS d2 FROM {_PAIRS} ON true)) WHERE r <= 3"


@register("estimator_kneighbors", _KNN3)
def _(pts):
    t1, t2 = epochs(pts)
    return r6(NearestNeighbors(3).fit(t1).kneighbors(t2), "distance")


@register("estimator_radius", f"SELECT sid AS source_id, tid AS target_id, round(sqrt(d2), 6) AS distance FROM ({_near_sql(15.0)})")
def _(pts):
    t1, t2 = epochs(pts)
    return NearestNeighbors(radius=15.0).fit(t1).radius_neighbors(t2, digits=6)


@register("facade_c2c", f"SELECT s.sid AS source_id, coalesce(n.target_id, -1) AS target_id, coalesce(n.distance, 'infinity'::double) AS distance FROM (SELECT point_id AS sid FROM pts WHERE epoch = 't2' AND classification = 2) s LEFT JOIN ({_NEAREST}) n ON s.sid = n.source_id")
def _(pts):
    t1, t2 = epochs(pts)
    return r6(ChangeDetector.c2c_within(t2, t1, REACH), "distance")


@register("matched_bucket_join", f"SELECT sid AS source_id, tid AS target_id, round(d2, 6) AS d2 FROM ({_MATCH})")
def _(pts):
    with held_at_most(0):
        t1, t2 = epochs(pts)
        return registration.matched(t2, t1, 8.0).select("source_id", "target_id", F.round("d2", 6).alias("d2"))


def _by_bucket(name: str) -> None:
    """Registers a query once more with both sides taken for large ones: they meet in an equi-join, as clouds over the bound do."""

    once = QUERIES[name]

    def run(spark, sf_dir):
        with held_at_most(0):
            return once(spark, sf_dir)

    QUERIES[f"{name}_by_bucket"], ORACLES[f"{name}_by_bucket"] = run, ORACLES[name]


for _name in ("c2c_nn", "c2c_tiled_inf", "radius_count", "vertical_plane_radius", "m3c2_upright", "kabsch_sums", "icp_align"):
    _by_bucket(_name)


@register("knn_k5_by_bucket", _body("knn_k5"))
def _(pts):
    with held_at_most(0):
        t1, t2 = epochs(pts)
        return r6(neighbors.knn(t2, t1, 5, start=CELL), "distance").select("source_id", "target_id", "distance", "rank")


def _by_leaves(name: str) -> None:
    """Registers a search once more, over a quadtree of the target as for clouds over the bound."""
    once = QUERIES[name]

    def run(spark, sf_dir):
        with held_at_most(0):
            return once(spark, sf_dir)

    QUERIES[f"{name}_by_leaves"], ORACLES[f"{name}_by_leaves"] = run, ORACLES[name]


for _name in ("knn_k5", "knn_self_k5", "c2c_unbounded", "vertical_plane_knn"):
    _by_leaves(_name)

#: Every other point is moved into a place as wide as a bucket of REACH, a two-hundredth of the cloud.
_CROWD = {c: f"CASE WHEN point_id % 2 = 0 THEN 500 + {c} / 200 ELSE {c} END" for c in "xy"}


@register("knn_crowded_place", f"""SELECT sid AS source_id, tid AS target_id, round(sqrt(d2), 6) AS distance, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY d2, tid) AS r
FROM (SELECT s.*, t.*, {_D2} AS d2 FROM {_PAIRS.replace("x AS", _CROWD["x"] + " AS").replace("y AS", _CROWD["y"] + " AS")} ON true)) WHERE r <= 3""")
def _(pts):
    t1, t2 = epochs(pts.withColumns({c: F.expr(e) for c, e in _CROWD.items()}))
    found = quadtree.nearest(neighbors.sources(t2), neighbors.targets(t1), 3, leaf=5_000, group=20_000)
    return found.select("source_id", "target_id", F.round(F.sqrt("d2"), 6).alias("distance"), "rank")


@register("layout_box", "SELECT point_id, x, y, classification FROM pts WHERE x BETWEEN 200.0::double AND 820.0::double AND y BETWEEN 150.0::double AND 777.0::double")
def _(pts):
    path = stage_path(pts.sparkSession, "layout")
    layout.write_layout(pts, path, 32)
    return layout.scan_box(pts.sparkSession, path, INNER, ["point_id", "x", "y", "classification"])


@register("layout_bounds", "SELECT min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y, count(*) AS n_points FROM pts")
def _(pts):
    path = stage_path(pts.sparkSession, "layout")
    layout.write_layout(pts, path, 32)
    return layout.layout_bounds(pts.sparkSession, path).drop("n_files")


_RUN = {"coordinates": {"origin": "min_bounds"}, "icp": {"enabled": False}, "dod": {"cell": 25.0}, "c2c": {"enabled": False}, "m3c2": {"enabled": False}}


def _run(pts: DataFrame):
    """A whole run by settings that come from a file."""
    path = stage_path(pts.sparkSession, "settings.json")
    sinks.write_text(pts.sparkSession, path, json.dumps(_RUN))
    settings: Settings = parse_settings(sinks.read_text(pts.sparkSession, path))
    return compare_epochs(pts.where("epoch = 't1'"), pts.where("epoch = 't2'"), settings)


@register("workflow_dod", """SELECT a.cx AS cell_x, a.cy AS cell_y, round(b.v - a.v, 6) AS dod FROM
(SELECT CAST(floor((x - x0) / 25.0::double) AS INT) AS cx, CAST(floor((y - y0) / 25.0::double) AS INT) AS cy, avg(z) AS v FROM pts, (SELECT min(x) AS x0, min(y) AS y0 FROM pts WHERE classification = 2) WHERE epoch = 't1' AND classification = 2 GROUP BY 1, 2) a JOIN
(SELECT CAST(floor((x - x0) / 25.0::double) AS INT) AS cx, CAST(floor((y - y0) / 25.0::double) AS INT) AS cy, avg(z) AS v FROM pts, (SELECT min(x) AS x0, min(y) AS y0 FROM pts WHERE classification = 2) WHERE epoch = 't2' AND classification = 2 GROUP BY 1, 2) b ON a.cx = b.cx AND a.cy = b.cy""")  # fmt: skip
def _(pts):
    return r6(_run(pts).dod, "dod").select("cell_x", "cell_y", "dod")


@register("streaming_dod", f"SELECT cell_x, cell_y, dod FROM ({_dod_sql('avg(z)', clamp=False)})")
def _(pts):
    spark, path, mark = pts.sparkSession, stage_path(pts.sparkSession, "arriving"), stage_path(pts.sparkSession, "progress")
    filters.filter_classes(pts).repartition(4).write.parquet(path)
    name = "running_" + path.rsplit("-", 1)[1]
    q = running_dod(arriving_points(spark, path, pts.schema, 2), EXTENT, CELL).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", mark).trigger(availableNow=True).start()
    q.awaitTermination()
    return r6(spark.table(name).where("dod IS NOT NULL"), "dod").select("cell_x", "cell_y", "dod")


@register("cell_of_point", f"SELECT point_id, {_CX} AS cell_x, {_CY} AS cell_y FROM pts")
def _(pts):
    return grid.with_cells(pts, EXTENT, CELL, True).select("point_id", "cell_x", "cell_y")


@register("crs_texts", "SELECT CAST(n_nationkey AS INT) AS key, CAST(25828 + n_nationkey % 11 AS INT) AS epsg FROM nation", points=False)
def _(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    texts = F.array(*(F.lit(sinks.wkt_of(25828 + i)) for i in range(11)))
    return n.select(F.col("n_nationkey").cast("int").alias("key"), points.epsg_of(F.element_at(texts, (F.col("n_nationkey") % 11 + 1).cast("int"))).alias("epsg"))


@register("cores_file", "SELECT point_id, x, y, z FROM pts WHERE classification = 2 ORDER BY md5(point_id::varchar || ':0'), point_id LIMIT 300")
def _(pts):
    path = stage_path(pts.sparkSession, "cores")
    sinks.write_cores(sampling.sample(filters.filter_classes(pts), 300), path)
    return sinks.read_cores(pts.sparkSession, path)


@register("run_log", "SELECT 25.0::double AS cell, false AS icp, 'min_bounds' AS origin, count(*) AS points FROM pts")
def _(pts):
    spark, path = pts.sparkSession, stage_path(pts.sparkSession, "run.json")
    sinks.write_run_log(spark, path, {"points": pts.count()}, parse_settings(json.dumps(_RUN)))
    read = spark.read.option("multiLine", True).json(path)
    return read.select(F.col("settings.dod.cell").alias("cell"), F.col("settings.icp.enabled").alias("icp"), F.col("settings.coordinates.origin").alias("origin"), F.col("arguments.points").alias("points"))


@register("synthetic_tile_set", """SELECT CAST(i AS INT) AS tile_i, CAST(j AS INT) AS tile_j, 'tile_0' || i || '_0' || j || '_t1' AS file, count(*) AS n FROM (SELECT least(1, floor(((id % 100) - 50.0::double + 50) / 50))::BIGINT AS i, least(1, floor(((id // 100) - 50.0::double + 50) / 50))::BIGINT AS j
FROM range(10000) r(id) WHERE ((('0x' || substr(md5(id || ':3:2'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE) < 0.4::DOUBLE) GROUP BY 1, 2, i, j""", points=False)  # fmt: skip
def _(spark, sf_dir):
    return points.synthetic_tiles(spark, 2, 50, keep=0.4, seed=3).groupBy("tile_i", "tile_j", "file").agg(F.count(F.lit(1)).alias("n"))


_HILLS = [("mound", 5.0, 20, -10, 6), ("pit", 5.0, -25, 30, 7), ("mound", 3.0, -30, -35, 9), ("ridge", 4.0, 5, 0, 8), ("slide", 4.0, 35, 35, 10)]
_FAR = _turned(0.0, 0.0, 35.0, (7.0, -4.0, 2.0))


@register("coarse_features", _matrix_sql(_FAR, 1), points=False)
def _(spark, sf_dir):
    a = points.synthetic(spark, 110, 110, keep=0.9, seed=6, features=_HILLS)
    b = apply_transform(points.synthetic(spark, 110, 110, keep=0.9, seed=7, features=_HILLS), _FAR)
    return _matrix_rows(spark, [[*r[:3], round(r[3])] for r in registration.coarse(a, b, "fpfh", cell=2.0)], 1)  # shifts to the metre
