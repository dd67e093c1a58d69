"""Elevation grids of points that keep arriving. Cells never expire, so no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stratamesh.functions.geometry import Bounds
from stratamesh.operators.grid import with_cells


def arriving_points(spark: SparkSession, folder: str, schema: StructType | str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def running_dod(points: DataFrame, b: Bounds, cell: float) -> DataFrame:
    """(cell_x, cell_y, dem1, dem2, dod, n1, n2) of points with an epoch t1 or t2, for output mode update or complete. The state is a sum and a count for each cell and epoch."""
    side = lambda e: F.when(F.col("epoch") == e, F.col("z"))
    grid = with_cells(points, b, cell, False).groupBy("cell_x", "cell_y").agg(F.avg(side("t1")).alias("dem1"), F.avg(side("t2")).alias("dem2"), F.count(side("t1")).alias("n1"), F.count(side("t2")).alias("n2"))
    return grid.withColumn("dod", F.col("dem2") - F.col("dem1"))
