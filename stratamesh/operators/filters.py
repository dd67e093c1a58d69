"""Row filters: classes, boxes, polygons, periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratamesh.functions.geometry import Bounds

GROUND = 2


def class_condition(ground_only: bool = True, classes: Sequence[int] | None = None) -> Column:
    """A list of classes decides alone; else ground only; else all."""
    if classes is not None:
        return F.col("classification").isin(list(classes))
    return F.col("classification") == GROUND if ground_only else F.lit(True)


def filter_classes(points: DataFrame, ground_only: bool = True, classes: Sequence[int] | None = None) -> DataFrame:
    return points.where(class_condition(ground_only, classes))


def filter_statistics(points: DataFrame, ground_only: bool = True, classes: Sequence[int] | None = None) -> DataFrame:
    """(total, kept, percent) in one pass."""
    kept = F.count_if(class_condition(ground_only, classes))
    return points.agg(F.count(F.lit(1)).alias("total"), kept.alias("kept")).withColumn("percent", F.coalesce(F.try_divide(100.0 * F.col("kept"), F.col("total")), F.lit(0.0)))


def in_box(b: Bounds) -> Column:
    """All four sides belong to the box. Plain comparisons, so the scan skips row groups by them."""
    return F.col("x").between(b.min_x, b.max_x) & F.col("y").between(b.min_y, b.max_y)


def filter_box(points: DataFrame, b: Bounds) -> DataFrame:
    return points.where(in_box(b))


def filter_finite(points: DataFrame, column: str) -> DataFrame:
    """Rows whose value is a number: not null, not NaN, not infinite."""
    c = F.col(column)
    return points.where(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def first_periods(catalog: DataFrame, years: Sequence[str] | None = None, n: int = 2) -> DataFrame:
    """Of every area, the first n periods by name; of those that hold one of the years, if years are given."""
    if years:
        cond = F.lit(False)
        for y in years:
            cond = cond | F.col("time_period").contains(str(y))
        catalog = catalog.where(cond)
    names = catalog.select("area", "time_period").distinct()
    return names.withColumn("rank", F.row_number().over(Window.partitionBy("area").orderBy("time_period"))).where(F.col("rank") <= n)


def areas_with_change(catalog: DataFrame) -> DataFrame:
    """Areas of two periods and more, with their number."""
    return catalog.groupBy("area").agg(F.countDistinct("time_period").alias("periods")).where("periods >= 2")
