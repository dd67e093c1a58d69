"""Samples that are the same on every run: rows are taken in the order of a hash of their id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_hash(id_col: str = "point_id", seed: int = 0) -> Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))


def sample(points: DataFrame, n: int, id_col: str = "point_id", seed: int = 0) -> DataFrame:
    """n rows without replacement, all if there are fewer: each task offers its n first, so nothing is sorted as a whole."""
    return points.withColumn("_h", order_hash(id_col, seed)).orderBy("_h", id_col).limit(n).drop("_h")


def sample_per(points: DataFrame, by: list[str], n: int, id_col: str = "point_id", seed: int = 0) -> DataFrame:
    """At most n rows of each group."""
    w = Window.partitionBy(*by).orderBy(order_hash(id_col, seed), id_col)
    return points.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def percent_per(points: DataFrame, by: list[str], percent: float, id_col: str = "point_id", seed: int = 0) -> DataFrame:
    """max(1, floor(n * percent / 100)) rows of each group of n, those first in the order of their ids' hashes.

    A group falls into 4096 parts by its hashes' first digits. Counts of the parts, in order, tell which are taken whole, and the
    one that is cut is numbered by itself, so a crowded group is never in one task. Rows with null keys are a group as any other.
    """
    hashed = points.withColumns({"_h": order_hash(id_col, seed), **{f"_g{i}": F.struct(c) for i, c in enumerate(by)}}).withColumn("_part", F.substring("_h", 1, 3))
    group = [f"_g{i}" for i in range(len(by))]
    counts = hashed.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.withColumns({"_all": F.sum("_n").over(whole), "_before": F.coalesce(F.sum("_n").over(before), F.lit(0))})
    take = sums.withColumn("_need", F.greatest(F.lit(1), F.floor(F.col("_all") * F.lit(percent / 100.0))) - F.col("_before")).where("_need > 0").select(*group, "_part", "_need")
    ranked = hashed.join(take, [*group, "_part"]).withColumn("_r", F.row_number().over(Window.partitionBy(*group, "_part").orderBy("_h", id_col)))
    return ranked.where(F.col("_r") <= F.col("_need")).select(*points.columns)


def core_points(points: DataFrame, percent: float = 10.0, count: int | None = None, seed: int = 0) -> DataFrame:
    """Core points: a number if one is given, else a percentage held to 0.1..100, of all points. A percentage is taken part by part, as in percent_per()."""
    if count is not None:
        return sample(points, count, seed=seed)
    return percent_per(points.withColumn("_cloud", F.lit(0)), ["_cloud"], min(100.0, max(0.1, percent)), seed=seed).drop("_cloud")
