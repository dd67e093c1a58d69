"""Where points come from: Parquet, tables, directories, synthetic surfaces."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamesh.functions.geometry import Bounds
from stratamesh.operators.filters import class_condition, in_box
from stratamesh.operators.transforms import LocalFrame

POINT_COLUMNS = ("epoch", "point_id", "x", "y", "z", "classification")


def lineitem_points(spark: SparkSession, sf_dir: str, scale: float = 1.0) -> DataFrame:
    """lineitem as a cloud of two epochs; coordinates are divided by scale. point_id is made of the row's keys and fits a long up to nine billion orders."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    day = F.datediff("l_shipdate", F.lit("1995-01-01").cast("date")).cast("double")
    out = df.select(
        F.when(F.col("l_linestatus") == "F", "t1").otherwise("t2").alias("epoch"),
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000_000 + F.col("l_partkey") % 100_000 * 1000 + F.col("l_suppkey") % 1000).alias("point_id"),
        (F.col("l_extendedprice") / 100.0).alias("x"), (day * 0.4).alias("y"), (F.col("l_quantity") + 100.0 * F.col("l_discount")).alias("z"), F.col("l_linenumber").alias("classification"))
    return out if scale == 1.0 else out.withColumns({c: F.col(c) / F.lit(scale) for c in "xyz"})


def lineitem_points_sql(scale: float = 1.0) -> str:
    """lineitem_points() in DuckDB's SQL."""
    return f"""SELECT CASE WHEN l_linestatus = 'F' THEN 't1' ELSE 't2' END AS epoch,
       (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey % 100000 * 1000 + l_suppkey % 1000 AS point_id,
       l_extendedprice / 100.0::double / {scale}::double AS x,
       date_diff('day', TIMESTAMP '1995-01-01', l_shipdate)::double * 0.4::double / {scale}::double AS y,
       (l_quantity + 100.0::double * l_discount) / {scale}::double AS z, l_linenumber AS classification FROM lineitem"""


def scan_points(spark: SparkSession, paths: str | Sequence[str], ground_only: bool = True, classes: Sequence[int] | None = None, box: Bounds | None = None, frame: LocalFrame | None = None, columns: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Points of Parquet files: class and box conditions and the column list go to the scan; the shift to a local frame comes after. With `file`, the file of each row."""
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    df = df.where(class_condition(ground_only, classes)) if "classification" in df.columns else df
    if box:
        df = df.where(in_box(box))
    cols: list[Column | str] = [c for c in columns if c != "file"]
    if "file" in columns:
        cols.append(F.col("_metadata.file_path").alias("file"))
    df = df.select(*cols)
    return frame.to_local(df) if frame else df


def file_bounds(points: DataFrame, by: str = "file") -> DataFrame:
    """(file, box): one row for each file."""
    return points.groupBy(by).agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"), F.count(F.lit(1)).alias("n_points"))


def union_bounds(*boxes: DataFrame) -> DataFrame:
    """The box around all boxes."""
    both = boxes[0].select("min_x", "min_y", "max_x", "max_y")
    for b in boxes[1:]:
        both = both.unionByName(b.select("min_x", "min_y", "max_x", "max_y"))
    return both.agg(F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"))


def files_for_tiles(tiles: DataFrame, files: DataFrame) -> DataFrame:
    """(tile_i, tile_j, file): files whose box meets a tile's outer box, edges included. Files are dealt over the tiles' own raster, so this is an equi-join."""
    size = tiles.agg(F.max(F.col("max_x") - F.col("min_x")).alias("w"), F.max(F.col("max_y") - F.col("min_y")).alias("h"), F.min("min_x").alias("x"), F.min("min_y").alias("y"), F.max(F.col("min_x") - F.col("outer_min_x")).alias("halo")).first()
    pad, w, h = float(size["halo"] or 0), float(size["w"] or 1) or 1.0, float(size["h"] or 1) or 1.0
    top = tiles.agg(F.max("tile_i"), F.max("tile_j")).first()

    def span(lo: str, hi: str, start: float, step: float, last: int) -> Column:
        at = lambda c, off: F.greatest(F.lit(0), F.least(F.lit(last), F.floor((F.col(c) + off - start) / step))).cast("int")
        return F.sequence(F.greatest(F.lit(0), at(lo, -pad) - 1), at(hi, pad))

    spread = files.withColumn("tile_i", F.explode(span("min_x", "max_x", size["x"], w, top[0]))).withColumn("tile_j", F.explode(span("min_y", "max_y", size["y"], h, top[1])))
    f = spread.select("tile_i", "tile_j", "file", *(F.col(c).alias(f"f_{c}") for c in ("min_x", "min_y", "max_x", "max_y")))
    met = tiles.join(f, ["tile_i", "tile_j"])
    return met.where("f_min_x <= outer_max_x AND f_max_x >= outer_min_x AND f_min_y <= outer_max_y AND f_max_y >= outer_min_y").select("tile_i", "tile_j", "file")


def discover(spark: SparkSession, base: str, layout: str = "nested", area: str | None = None, pattern: str = "*.parquet") -> DataFrame:
    """(area, time_period, path) of base/area/period/data/* (nested) or base/area/period/* (flat), by Spark's own listing. Dot folders are skipped; a base without files gives no rows."""
    if layout not in ("nested", "flat"):
        raise ValueError("layout: nested or flat")
    glob = f"{base.rstrip('/')}/*/*/{'data/' if layout == 'nested' else ''}{pattern}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(glob)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    rows = []
    for status in found:
        p = status.getPath().toString()
        parts = p.split("/")[: -1 - (layout == "nested")]
        if not parts[-1].startswith(".") and not parts[-2].startswith(".") and (area is None or parts[-2] == area):
            rows.append((parts[-2], parts[-1], p))
    return spark.createDataFrame(sorted(rows), "area string, time_period string, path string")


def load_dataset(spark: SparkSession, catalog: DataFrame, per_file: int | None = None, seed: int = 0) -> DataFrame:
    """All points of a catalog's files with area, time_period and file; columns that a file lacks are null there. per_file: a sample of each file. ValueError for an empty catalog.

    One scan of all paths, whatever their number; the catalog, one row a file, meets it by the path that Spark knows of each row.
    """
    from stratamesh.operators.sampling import sample_per

    entries = [tuple(r) for r in catalog.select("path", "area", "time_period").collect()]  # a row for each file to open, none for a point
    if not entries:
        raise ValueError("the catalog is empty")
    df = spark.read.option("mergeSchema", True).parquet(*(p for p, _, _ in entries))
    plain = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")
    own = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    folder = F.regexp_replace(own, "/[^/]*$", "")  # a file written by Spark is a folder
    df = df.withColumn("_at", plain(F.when(folder.rlike(r"\.parquet$"), folder).otherwise(own)))
    names = spark.createDataFrame([(re.sub("^([a-z0-9]+):/+", r"\1:/", p if ":" in p.split("/")[0] else f"file:{p}"), a, t, p) for p, a, t in entries], "_at string, area string, time_period string, file string")
    out = df.join(names, "_at").drop("_at")
    return sample_per(out, ["file"], per_file, seed=seed) if per_file else out


def epsg_of(wkt: Column) -> Column:
    """The EPSG code of a coordinate system's text, or null: the older AUTHORITY form first, then ID."""
    find = lambda p: F.nullif(F.regexp_extract(wkt, p, 1), F.lit(""))
    # the last one closes the whole system
    old = find(r'(?s).*AUTHORITY\["EPSG",\s*"(\d+)"\]')
    return F.coalesce(old, find(r'(?s).*ID\["EPSG",\s*(\d+)\]')).cast("int")


def histogram_csv(spark: SparkSession, path: str) -> DataFrame:
    """(bin, value, bin_start, bin_end, centre) of a semicolon-separated histogram file with a header."""
    df = spark.read.option("sep", ";").option("header", True).schema("bin int, value long, bin_start double, bin_end double").csv(path)
    return df.withColumn("centre", (F.col("bin_start") + F.col("bin_end")) / 2)


def distance_column(df: DataFrame) -> DataFrame:
    """Adds `distance` from the first of m3c2_distance and distance that is there, else the first other number; ValueError without one."""
    names = [c for c in ("m3c2_distance", "distance") if c in df.columns] or [c for c, t in df.dtypes if t in ("double", "float") and c not in "xyz"]
    if not names:
        raise ValueError("no distance column")
    return df.withColumn("distance", F.col(names[0]).cast("double"))


_SHAPES = re.compile("mound|pit|slide|ridge")


def _uniform(key: Column, seed: int, draw: int) -> Column:
    """A number between 0 and 1 that depends on nothing but key, seed and draw."""
    digits = F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)), F.lit(str(draw)))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def synthetic(spark: SparkSession, nx: int = 500, ny: int = 500, step: float = 1.0, keep: float = 0.25, epoch: str = "t1", noise: float = 0.02, features: Sequence[tuple[str, float, float, float, float]] = (), seed: int = 0) -> DataFrame:
    """A rolling surface around the origin with normal noise, each raster point kept with probability `keep`, made on the executors and the same however it is partitioned.

    features: (mound, pit, slide or ridge; height; x; y; radius). A slide rises on one side and sinks on the other.
    """
    base = spark.range(nx * ny)
    x = ((F.col("id") % nx) - nx / 2) * F.lit(step)
    y = (F.floor(F.col("id") / nx) - ny / 2) * F.lit(step)
    z = 10 + 2 * F.sin(x / 35) + 1.5 * F.cos(y / 27) + 0.01 * x
    for kind, height, cx, cy, radius in features:
        if not _SHAPES.fullmatch(kind):
            raise ValueError(f"unknown feature {kind}")
        dx, dy = x - cx, y - cy
        bell = F.exp(-(dx * dx + dy * dy) / (2 * radius * radius))
        if kind == "ridge":
            bell = F.exp(-(dx * dx) / (2 * radius * radius))
        if kind == "slide":
            bell = bell * F.cos(F.atan2(dy, dx))
        z = z + (-height if kind == "pit" else height) * bell
    u, v, w = (_uniform(F.col("id"), seed, i) for i in range(3))
    bell_noise = F.sqrt(-2.0 * F.log(u)) * F.cos(2 * math.pi * v)
    shaped = base.select(F.lit(epoch).alias("epoch"), F.col("id").alias("point_id"), x.cast("double").alias("x"), y.cast("double").alias("y"), (z + noise * bell_noise).alias("z"), F.lit(2).alias("classification"), w.alias("_u"))
    return shaped.where(F.col("_u") < keep).drop("_u")


def synthetic_tiles(spark: SparkSession, across: int = 4, side: int = 1000, step: float = 1.0, **options) -> DataFrame:
    """synthetic() of across * across square tiles of side * side raster points, with tile_i, tile_j and the name of each tile's file."""
    points = synthetic(spark, across * side, across * side, step, **options)
    low, width = -across * side * step / 2, side * step
    at = {f"tile_{n}": F.least(F.lit(across - 1), F.floor((F.col(c) - low) / width)).cast("int") for n, c in (("i", "x"), ("j", "y"))}
    return points.withColumns(at).withColumn("file", F.format_string("tile_%02d_%02d_%s", "tile_i", "tile_j", "epoch"))
