"""Summaries of distances, classes and catalogs."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamesh.operators.quantiles import quantiles
from stratamesh.staging import staged, unstage


_TYPES = {int: "long", float: "double", type(None): "double"}


def _described(df: DataFrame, column: str, aggregates: Callable[[Column], dict[str, Column]], at: dict[str, float]) -> tuple[dict, DataFrame]:
    """(the aggregates of a column named v and its exact quantiles, the column's values as a written table). Values are written once and read by each pass."""
    values = staged(df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL"), "values")
    row = values.agg(F.count("v").alias("_n"), *(c.alias(k) for k, c in aggregates(F.col("v")).items())).first().asDict()
    return row | dict(zip(at, quantiles(values, "v", list(at.values()), row["_n"]), strict=True)), values


def _one_row(spark: SparkSession, **columns) -> DataFrame:
    return spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} {_TYPES[type(v)]}" for k, v in columns.items()))


def distance_statistics(df: DataFrame, column: str = "distance", cutoff: float | None = None) -> DataFrame:
    """(n, mean, median, rmse) over values up to the cutoff; without any: 0, NaN, NaN, infinity. The median is exact and no task holds all values."""
    rows = df if cutoff is None else df.where(F.col(column) <= cutoff)
    d, values = _described(rows, column, lambda v: {"mean": F.avg(v), "rmse": F.sqrt(F.avg(v * v))}, {"median": 0.5})
    unstage(values)
    none = {"mean": math.nan, "median": math.nan, "rmse": math.inf} if not d["_n"] else d
    return _one_row(df.sparkSession, n=d["_n"], mean=none["mean"], median=none["median"], rmse=none["rmse"])


def change_statistics(df: DataFrame, column: str = "distance") -> DataFrame:
    """(n_valid, mean, median, std, rmse) with the population's standard deviation; nulls without any value."""
    d, values = _described(df, column, lambda v: {"mean": F.avg(v), "std": F.stddev_pop(v), "rmse": F.sqrt(F.avg(v * v))}, {"median": 0.5})
    unstage(values)
    return _one_row(df.sparkSession, n_valid=d["_n"], mean=d["mean"], median=d["median"], std=d["std"], rmse=d["rmse"])


def grid_statistics(df: DataFrame, column: str = "dod") -> DataFrame:
    """(n_cells, mean_change, median_change, rmse, min_change, max_change) over cells with a difference; nulls without any."""
    d, values = _described(df, column, lambda v: {"mean": F.avg(v), "rmse": F.sqrt(F.avg(v * v)), "min": F.min(v), "max": F.max(v)}, {"median": 0.5})
    unstage(values)
    return _one_row(df.sparkSession, n_cells=d["_n"], mean_change=d["mean"], median_change=d["median"], rmse=d["rmse"], min_change=d["min"], max_change=d["max"])


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int = 256) -> DataFrame:
    """(bin, n, centre) of non-empty bins from 1; the last bin holds its upper edge, values outside count nowhere."""
    c, width = F.col(column), (high - low) / bins
    inside = df.where(c.between(low, high))
    counted = inside.groupBy(F.least(F.width_bucket(c, F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("centre", F.lit(low) + (F.col("bin") - 0.5) * width)


def sign_summary(df: DataFrame, column: str) -> DataFrame:
    """(n, percent_positive, percent_negative, median, p5, p95, p95_abs); nulls without any value."""
    share = lambda cond: F.try_divide(100.0 * F.count_if(cond), F.count("v"))
    d, values = _described(df, column, lambda v: {"up": share(v > 0), "down": share(v < 0)}, {"median": 0.5, "p5": 0.05, "p95": 0.95})
    (p95_abs,) = quantiles(values.select(F.abs("v").alias("v")), "v", [0.95], d["_n"])
    unstage(values)
    return _one_row(df.sparkSession, n=d["_n"], percent_positive=d["up"], percent_negative=d["down"], median=d["median"], p5=d["p5"], p95=d["p95"], p95_abs=p95_abs)


def pearson(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, r) over rows with both; NaN for fewer than two rows or a constant side."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.corr(a, b).alias("r"), F.stddev_pop(a).alias("u"), F.stddev_pop(b).alias("v"))
    return got.select("n", F.when((F.col("n") < 2) | (F.col("u") == 0) | (F.col("v") == 0) | F.col("r").isNull(), F.lit(float("nan"))).otherwise(F.col("r")).alias("r"))


def distance_report(df: DataFrame, column: str = "distance") -> DataFrame:
    """(count, min, max, mean, std, median, p5, p95, significant, percent_significant); significant: over mean + 2 std. Without any value: 0 and nulls, percent 0."""
    d, values = _described(df, column, lambda v: {"min": F.min(v), "max": F.max(v), "mean": F.avg(v), "std": F.stddev_pop(v)}, {"median": 0.5, "p5": 0.05, "p95": 0.95})
    over = values.where(F.col("v") > d["mean"] + 2 * d["std"]).count() if d["_n"] else 0
    unstage(values)
    return _one_row(
        df.sparkSession, count=d["_n"], min=d["min"], max=d["max"], mean=d["mean"], std=d["std"], median=d["median"], p5=d["p5"], p95=d["p95"],
        significant=over, percent_significant=100.0 * over / d["_n"] if d["_n"] else 0.0)


def class_histogram(points: DataFrame, *by: str) -> DataFrame:
    return points.groupBy(*by, "classification").agg(F.count(F.lit(1)).alias("n"))


def file_metadata(points: DataFrame, by: str = "file") -> DataFrame:
    """A row for each file: counts, class counts as a map, box, and mean, deviation of its ground points (of all points where it has none)."""
    ground = F.col("classification") == 2
    cls = points.groupBy(by, "classification").agg(F.count(F.lit(1)).alias("n"))
    maps = cls.groupBy(by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("classification", "n")))).alias("classes"))
    aggs = [F.count(F.lit(1)).alias("n_points"), F.count_if(ground).alias("n_ground")]
    for c in "xyz":
        aggs += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), F.coalesce(F.avg(F.when(ground, F.col(c))), F.avg(c)).alias(f"mean_{c}"), F.coalesce(F.stddev_pop(F.when(ground, F.col(c))), F.stddev_pop(c)).alias(f"std_{c}")]
    return points.groupBy(by).agg(*aggs).withColumn("ground_percent", 100.0 * F.col("n_ground") / F.col("n_points")).join(maps, by)


def file_validity(points: DataFrame, by: str = "file") -> DataFrame:
    """(file, n, valid): whether a file has points and all coordinates are finite."""
    bad = F.lit(False)
    for c in "xyz":
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return points.groupBy(by).agg(F.count(F.lit(1)).alias("n"), (F.count_if(bad) == 0).alias("valid"))


def catalog_rollup(points: DataFrame) -> DataFrame:
    """(area, time_period, n_points, n_ground, ground_percent, box) of points with area and time_period."""
    return points.groupBy("area", "time_period").agg(
        F.count(F.lit(1)).alias("n_points"), F.count_if(F.col("classification") == 2).alias("n_ground"),
        *(f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max)))).withColumn("ground_percent", 100.0 * F.col("n_ground") / F.col("n_points"))


def epoch_pairs(catalog: DataFrame) -> DataFrame:
    """(area, first, second): every two periods of an area, the earlier name first."""
    names = catalog.select("area", "time_period").distinct()
    a, b = names.select("area", F.col("time_period").alias("first")), names.select("area", F.col("time_period").alias("second"))
    return a.join(b, "area").where("first < second")


def density(points: DataFrame) -> DataFrame:
    """(n, area, density) over the box of the points."""
    area = F.greatest(F.lit(1e-6), (F.max("x") - F.min("x")) * (F.max("y") - F.min("y")))
    return points.agg(F.count(F.lit(1)).alias("n"), area.alias("area")).withColumn("density", F.col("n") / F.col("area"))


def centroid(points: DataFrame) -> DataFrame:
    return points.agg(*(F.avg(c).alias(f"mean_{c}") for c in "xyz"))


def covariance(points: DataFrame) -> DataFrame:
    """The six population covariances of x, y and z."""
    return points.agg(*(F.covar_pop(a, b).alias(f"cov_{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")))


def top_classes(points: DataFrame, n: int = 5) -> DataFrame:
    return class_histogram(points).orderBy(F.desc("n"), "classification").limit(n)
