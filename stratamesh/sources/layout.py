"""Point tables laid out by place: files of neighbouring points beside a table of their boxes, so a box opens only files that meet it.

Points are range-partitioned by the Morton key of their place. The boxes are one row a file; bounds of a cloud and the
choice of files for a box or for tiles come from them, without a row of the points being read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamesh.functions.geometry import Bounds
from stratamesh.operators.filters import in_box

#: Bits of each coordinate in a Morton key.
BITS = 24
BOX = ("min_x", "min_y", "max_x", "max_y")


def _spread(v: Column) -> Column:
    """The lowest 32 bits of a long with a free bit before each: halves are moved apart, again and again, by half as far."""
    for step in (16, 8, 4, 2, 1):
        mask = sum(((1 << step) - 1) << at for at in range(0, 64, 2 * step))
        v = v.bitwiseOR(F.shiftleft(v, step)).bitwiseAND(F.lit(mask))
    return v


def morton_key(b: Bounds, x: str = "x", y: str = "y", bits: int = BITS) -> Column:
    """The bits of a place's column and row on a 2**bits raster over the box, taken in turn; places outside count as on its edge, those without a coordinate have none."""
    def at(c: str, lo: float, hi: float) -> Column:
        share = (F.col(c) - F.lit(lo)) / F.lit(max(hi - lo, 1e-300))
        cell = F.least(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * F.lit(float(1 << bits))).cast("long"), F.lit((1 << bits) - 1))
        return F.when(F.col(c).isNotNull(), cell)  # least() and greatest() would pass over a null

    return _spread(at(x, b.min_x, b.max_x)).bitwiseOR(F.shiftleft(_spread(at(y, b.min_y, b.max_y)), 1))


def write_layout(points: DataFrame, path: str, files: int, bounds: Bounds | None = None) -> DataFrame:
    """Writes points (x, y, ...) to path/points in about `files` files by place, and path/boxes; returns the boxes.

    Without bounds, one pass finds them first. Places that many points share are dealt over files by their other columns, so no
    file takes a crowded place whole. Rows without a place are kept, in files whose boxes leave them out; they are in no box.
    """
    spark = points.sparkSession
    if bounds is None:
        r = points.where("abs(x) < double('infinity') AND abs(y) < double('infinity')").agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
        bounds = Bounds(*map(float, r)) if r[0] is not None else Bounds(0.0, 0.0, 1.0, 1.0)
    key, rest = "_morton", "_rest"
    laid = points.withColumns({key: morton_key(bounds), rest: F.xxhash64(*(F.col(f"`{c}`") for c in points.columns))})
    laid.repartitionByRange(files, key, rest).sortWithinPartitions(key, rest).drop(key, rest).write.parquet(f"{path}/points")
    there = spark.read.schema(points.schema).parquet(f"{path}/points")
    known = lambda c: F.when(F.abs(F.col(c)) < F.lit(float("inf")), F.col(c))
    boxes = there.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.min(known("x")).alias("min_x"), F.min(known("y")).alias("min_y"), F.max(known("x")).alias("max_x"), F.max(known("y")).alias("max_y"), F.count(F.lit(1)).alias("n_points"))
    boxes.write.parquet(f"{path}/boxes")
    return layout_boxes(spark, path)


def layout_boxes(spark: SparkSession, path: str) -> DataFrame:
    """(file, min_x, min_y, max_x, max_y, n_points) of a layout."""
    return spark.read.parquet(f"{path}/boxes")


def layout_bounds(spark: SparkSession, path: str) -> DataFrame:
    """(min_x, min_y, max_x, max_y, n_points, n_files) of all points of a layout, from the boxes alone."""
    ends = [(F.min if c.startswith("min") else F.max)(c).alias(c) for c in BOX]
    return layout_boxes(spark, path).agg(*ends, F.coalesce(F.sum("n_points"), F.lit(0)).alias("n_points"), F.count(F.lit(1)).alias("n_files"))


def scan_box(spark: SparkSession, path: str, b: Bounds, columns: Sequence[str] | None = None) -> DataFrame:
    """The points of a layout in a box, edges included. Only files whose boxes meet it are opened; row groups of those are skipped by x and y."""
    meets = (F.col("min_x") <= b.max_x) & (F.col("max_x") >= b.min_x) & (F.col("min_y") <= b.max_y) & (F.col("max_y") >= b.min_y)
    files = [r["file"] for r in layout_boxes(spark, path).where(meets).select("file").collect()]  # names of files, as a scan's own listing
    all_ = spark.read.parquet(f"{path}/points")
    found = spark.read.schema(all_.schema).parquet(*files).where(in_box(b)) if files else all_.limit(0)
    return found.select(*columns) if columns else found
