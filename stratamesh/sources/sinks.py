"""Where results go: Parquet by epoch or file, moved and clipped copies, rasters as cell tables, small JSON and text."""

from __future__ import annotations

import dataclasses
import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamesh.functions.geometry import Matrix
from stratamesh.operators.clip import ClipArea, clip
from stratamesh.operators.raster import interpolate
from stratamesh.operators.transforms import LocalFrame, apply_transform
from stratamesh.plans.config import Settings

#: Names, datum codes and ellipsoids of the geographic systems that UTM zones are made of.
_GEOGRAPHIC = {
    4258: ("ETRS89", "European_Terrestrial_Reference_System_1989", 6258, "GRS 1980", 6378137, 298.257222101, 7019),
    4326: ("WGS 84", "WGS_1984", 6326, "WGS 84", 6378137, 298.257223563, 7030),
}


def _geographic(code: int) -> str:
    name, datum, datum_code, ellipsoid, axis, flattening, ellipsoid_code = _GEOGRAPHIC[code]
    spheroid = f'SPHEROID["{ellipsoid}",{axis},{flattening},AUTHORITY["EPSG","{ellipsoid_code}"]]'
    return f'GEOGCS["{name}",DATUM["{datum}",{spheroid},AUTHORITY["EPSG","{datum_code}"]],PRIMEM["Greenwich",0,AUTHORITY["EPSG","8901"]],UNIT["degree",0.0174532925199433,AUTHORITY["EPSG","9122"]],AUTHORITY["EPSG","{code}"]]'


def wkt_of(epsg: int) -> str:
    """The well-known text of ETRS89 / UTM zones (25828 to 25838), WGS 84 / UTM zones of either half (32601 to 32660, 32701 to 32760), WGS 84 and ETRS89. ValueError for others."""
    if epsg in _GEOGRAPHIC:
        return _geographic(epsg)
    for first, last, base, south in ((25828, 25838, 4258, False), (32601, 32660, 4326, False), (32701, 32760, 4326, True)):
        if first <= epsg <= last:
            zone = epsg % 100
            numbers = {"latitude_of_origin": 0, "central_meridian": 6 * zone - 183, "scale_factor": 0.9996, "false_easting": 500000, "false_northing": 10000000 if south else 0}
            plane = "".join(f',PARAMETER["{k}",{v}]' for k, v in numbers.items())
            return f'PROJCS["{_GEOGRAPHIC[base][0]} / UTM zone {zone}{"S" if south else "N"}",{_geographic(base)},PROJECTION["Transverse_Mercator"]{plane},UNIT["metre",1,AUTHORITY["EPSG","9001"]],AXIS["Easting",EAST],AXIS["Northing",NORTH],AUTHORITY["EPSG","{epsg}"]]'
    raise ValueError(f"no text for EPSG {epsg}")


def write_cores(cores: DataFrame, path: str) -> None:
    """Core points (point_id, x, y, z) as a table that read_cores() gives back."""
    cores.select("point_id", *(F.col(c).cast("double").alias(c) for c in "xyz")).write.mode("overwrite").parquet(path)


def read_cores(spark: SparkSession, path: str) -> DataFrame:
    """Core points of write_cores(), or of any Parquet table with these columns."""
    return spark.read.parquet(path).select("point_id", "x", "y", "z")


def write_json(spark: SparkSession, path: str, report: dict) -> None:
    """A small report; numbers that JSON lacks are null."""
    plain = {k: None if isinstance(v, float) and not math.isfinite(v) else v for k, v in report.items()}
    write_text(spark, path, json.dumps(plain, indent=1, default=str))


def write_run_log(spark: SparkSession, path: str, arguments: dict, settings: Settings) -> None:
    """What a run was started with: its arguments and all settings, defaults included."""
    write_json(spark, path, {"arguments": arguments, "settings": dataclasses.asdict(settings)})


def write_points(points: DataFrame, path: str, frame: LocalFrame | None = None, by: str | None = None) -> None:
    """Points, back in global coordinates if a frame is given; booleans as 0 and 1; a folder for each value of `by`."""
    df = frame.to_global(points) if frame else points
    df = df.withColumns({c: F.col(c).cast("tinyint") for c, t in df.dtypes if t == "boolean"})
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(path)


def clip_files(points: DataFrame, area: ClipArea, path: str, by: str = "file") -> None:
    """Points inside, all columns, a folder for each file that has any."""
    clip(points, area).write.mode("overwrite").partitionBy(by).parquet(path)


def transform_files(points: DataFrame, matrix: Matrix, path: str, frame: LocalFrame | None = None, by: str = "file", suffix: str = "_aligned") -> None:
    """Points moved in the local frame and written in the global one, a folder for each file, its name with a suffix."""
    local = frame.to_local(points) if frame else points
    moved = apply_transform(local, matrix)
    out = frame.to_global(moved) if frame else moved
    out.withColumn(by, F.concat(by, F.lit(suffix))).write.mode("overwrite").partitionBy(by).parquet(path)


def write_raster(points: DataFrame, value: str, path: str, cell: float = 1.0, frame: LocalFrame | None = None) -> None:
    """The raster of a value as a table of cells with their centres."""
    interpolate(frame.to_global(points) if frame else points, value, cell).write.mode("overwrite").parquet(path)


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file wherever Spark can write."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text (a transform, a boundary, the input of a run) wherever Spark can write."""
    write_bytes(spark, path, text.encode())


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]
