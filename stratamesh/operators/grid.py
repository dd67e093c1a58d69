"""Elevation grids and their differences. Grids are sparse: a cell without points has no row."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamesh.functions.geometry import Bounds, cell_centre, cell_clamped, cell_strict, grid_shape
from stratamesh.operators.statistics import grid_statistics
from stratamesh.staging import staged

AGGREGATES = {
    "mean": F.avg,
    "median": F.median,
    "p95": lambda c: F.percentile(c, F.lit(0.95)),
    "p5": lambda c: F.percentile(c, F.lit(0.05)),
}


def bounds_of(*clouds: DataFrame) -> Bounds:
    """The box around all points; ValueError without any."""
    both = clouds[0].select("x", "y")
    for c in clouds[1:]:
        both = both.unionByName(c.select("x", "y"))
    r = both.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if r[0] is None:
        raise ValueError("point clouds must not be empty")
    return Bounds(*map(float, r))


def with_cells(points: DataFrame, b: Bounds, cell: float, clamp: bool) -> DataFrame:
    """Adds cell_x and cell_y. Points outside: into edge cells if clamp, else let go."""
    nx, ny = grid_shape(b, cell)
    index = cell_clamped if clamp else cell_strict
    out = points.withColumns({"cell_x": index(F.col("x"), b.min_x, cell, nx), "cell_y": index(F.col("y"), b.min_y, cell, ny)})
    return out if clamp else out.where("cell_x IS NOT NULL AND cell_y IS NOT NULL")


def dem(points: DataFrame, b: Bounds, cell: float, aggregate: str = "mean", clamp: bool = True) -> DataFrame:
    """(cell_x, cell_y, value, n). The mean combines before the shuffle; exact quantiles can't."""
    if aggregate not in AGGREGATES:
        raise ValueError(f"unknown aggregate {aggregate}")
    return with_cells(points, b, cell, clamp).groupBy("cell_x", "cell_y").agg(AGGREGATES[aggregate](F.col("z")).alias("value"), F.count(F.lit(1)).alias("n"))


def _two(t1: DataFrame, t2: DataFrame) -> DataFrame:
    return t1.select("x", "y", "z", F.lit(1).alias("side")).unionByName(t2.select("x", "y", "z", F.lit(2).alias("side")))


def dod(t1: DataFrame, t2: DataFrame, cell: float = 1.0, b: Bounds | None = None, aggregate: str = "mean", clamp: bool = True, outer: bool = False, centres: bool = False) -> DataFrame:
    """(cell_x, cell_y, dem1, dem2, dod) of cells with points in both epochs; outer: of cells with points in either, dod null.

    Both epochs are gridded in one aggregation with one shuffle on the cell, which takes the join's place.
    """
    if aggregate not in AGGREGATES:
        raise ValueError(f"unknown aggregate {aggregate}")
    b = b or bounds_of(t1, t2)
    f = AGGREGATES[aggregate]
    of = lambda side: f(F.when(F.col("side") == side, F.col("z")))
    grid = with_cells(_two(t1, t2), b, cell, clamp).groupBy("cell_x", "cell_y").agg(of(1).alias("dem1"), of(2).alias("dem2"))
    if not outer:
        grid = grid.where("dem1 IS NOT NULL AND dem2 IS NOT NULL")
    grid = grid.withColumn("dod", F.col("dem2") - F.col("dem1"))
    if centres:
        grid = grid.withColumns({"centre_x": cell_centre(F.col("cell_x"), b.min_x, cell), "centre_y": cell_centre(F.col("cell_y"), b.min_y, cell)})
    return grid


def dod_statistics(grid: DataFrame, column: str = "dod") -> DataFrame:
    """(n_cells, mean_change, median_change, rmse, min_change, max_change) over cells with a difference."""
    return grid_statistics(grid, column)


def tiles(spark, b: Bounds, tile: float, halo: float = 0.0) -> DataFrame:
    """(tile_i, tile_j, inner and outer box) row by row; outer boxes have a halo and end at the extent."""
    tx, ty = (max(1, -int(-(hi - lo) // tile)) for lo, hi in ((b.min_x, b.max_x), (b.min_y, b.max_y)))
    grid = spark.range(tx * ty).select((F.col("id") % tx).cast("int").alias("tile_i"), F.floor(F.col("id") / tx).cast("int").alias("tile_j"))

    def edge(index: Column, low: float, high: float, upper: int) -> Column:
        return F.least(F.lit(high), F.lit(low) + (index + upper) * F.lit(tile))

    inner = {"min_x": edge(F.col("tile_i"), b.min_x, b.max_x, 0), "min_y": edge(F.col("tile_j"), b.min_y, b.max_y, 0), "max_x": edge(F.col("tile_i"), b.min_x, b.max_x, 1), "max_y": edge(F.col("tile_j"), b.min_y, b.max_y, 1)}
    out = grid.withColumns(inner)
    return out.withColumns({
        "outer_min_x": F.greatest(F.lit(b.min_x), F.col("min_x") - halo), "outer_min_y": F.greatest(F.lit(b.min_y), F.col("min_y") - halo),
        "outer_max_x": F.least(F.lit(b.max_x), F.col("max_x") + halo), "outer_max_y": F.least(F.lit(b.max_y), F.col("max_y") + halo),
    })


def tile_of(points: DataFrame, b: Bounds, tile: float) -> DataFrame:
    """Adds the tile every point belongs to: each to one, edges to the upper."""
    tx, ty = (max(1, -int(-(hi - lo) // tile)) for lo, hi in ((b.min_x, b.max_x), (b.min_y, b.max_y)))
    return points.withColumns({"tile_i": cell_clamped(F.col("x"), b.min_x, tile, tx), "tile_j": cell_clamped(F.col("y"), b.min_y, tile, ty)})


def in_tiles_meeting(points: DataFrame, b: Bounds, tile: float, box: Bounds) -> DataFrame:
    """Points of tiles that meet the box, edges included, with tile_i and tile_j."""
    own = tile_of(points, b, tile)
    meets = lambda c, low, lo, hi: (F.lit(low) + F.col(c) * F.lit(tile) <= F.lit(hi)) & (F.lit(low) + (F.col(c) + 1) * F.lit(tile) >= F.lit(lo))
    return own.where(meets("tile_i", b.min_x, box.min_x, box.max_x) & meets("tile_j", b.min_y, box.min_y, box.max_y))


def map_tiles(points: DataFrame, b: Bounds, tile: float, halo: float, work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """work(inner, outer) of every tile with inner points; outer: those within `halo` of it too. Its rows get tile_i and tile_j.

    A point goes to its own tile and to those whose halo it lies in. A task holds one tile's points, so `tile` is to be chosen by density.
    """
    tx, ty = (max(1, -int(-(hi - lo) // tile)) for lo, hi in ((b.min_x, b.max_x), (b.min_y, b.max_y)))
    own = tile_of(points, b, tile)
    near = lambda c, i, low, n: F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - F.lit(low + halo)) / tile)), F.least(F.lit(n - 1), F.floor((F.col(c) - F.lit(low - halo)) / tile)))
    span = lambda c, i, low, n: F.array_union(F.array(F.col(i).cast("long")), near(c, i, low, n))
    spread = own.withColumn("_i", F.explode(span("x", "tile_i", b.min_x, tx))).withColumn("_j", F.explode(span("y", "tile_j", b.min_y, ty)))
    spread = spread.withColumn("_inner", (F.col("_i") == F.col("tile_i")) & (F.col("_j") == F.col("tile_j"))).drop("tile_i", "tile_j")

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        inner = part["_inner"]
        rest = part.drop(columns=["_i", "_j", "_inner"])
        if not inner.any():
            return pd.DataFrame(columns=["tile_i", "tile_j", *(c.split()[0] for c in schema.split(", "))])
        return work(rest[inner], rest).assign(tile_i=int(key[0]), tile_j=int(key[1]))

    return spread.groupBy("_i", "_j").applyInPandas(run, f"{schema}, tile_i int, tile_j int")


def mosaic(points: DataFrame, b: Bounds, cell: float, tile: float) -> DataFrame:
    """(cell_x, cell_y, value): mean of a cell's tile means, each tile of weight 1."""
    nx, ny = grid_shape(b, cell)
    cells = tile_of(points, b, tile).withColumns({"cell_x": cell_strict(F.col("x"), b.min_x, cell, nx), "cell_y": cell_strict(F.col("y"), b.min_y, cell, ny)}).where("cell_x IS NOT NULL AND cell_y IS NOT NULL")
    return cells.groupBy("cell_x", "cell_y", "tile_i", "tile_j").agg(F.avg("z").alias("v")).groupBy("cell_x", "cell_y").agg(F.avg("v").alias("value"))


def occupancy(points: DataFrame, b: Bounds, cell: float) -> DataFrame:
    """(cell_x, cell_y, n, share): counts, and counts over the largest. Points are counted once; the counts are written and read again."""
    counts = staged(with_cells(points, b, cell, True).groupBy("cell_x", "cell_y").agg(F.count(F.lit(1)).alias("n")), "occupancy")
    top = counts.agg(F.max("n")).first()[0]
    return counts.withColumn("share", F.col("n") / F.lit(float(top or 1)))


def voxel_means(points: DataFrame, size: float) -> DataFrame:
    """One point for each voxel: the mean of its points."""
    v = {f"v{c}": F.floor(F.col(c) / F.lit(size)).cast("long") for c in "xyz"}
    return points.withColumns(v).groupBy(*v).agg(*(F.avg(c).alias(c) for c in "xyz"), F.count(F.lit(1)).alias("n"))
