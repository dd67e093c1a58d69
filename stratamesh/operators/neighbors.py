"""Neighbour joins. What is asked of a source's neighbours (the nearest ones, how many, their moments) is found tile by tile (around.fold), and no pair is shuffled.

Pairs themselves come from near_pairs() and pairs_within(): a side of at most point_index.MOST points is broadcast as a grid index, and the other is read once, without a shuffle.
Two large clouds meet in buckets. Points of one side get the bucket they lie in, points of the other all buckets in reach (3 x 3 of them); the join is an
equi-join on the bucket, which shuffles, spills and splits skewed buckets like any other, and an exact test follows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from stratamesh.functions.geometry import squared_distance
from stratamesh.operators import around, point_index, quadtree
from stratamesh.operators.point_index import PointIndex, index_of, matches, queries_of
from stratamesh.staging import staged, unstage

#: Sources that are sent to the targets at most, once they are all that is left of a search.
LONELY = 2_000

#: Ids that a row of a place holds, about, at most.
PACKED = 1_000

XYZ_S, XYZ_T = ("sx", "sy", "sz"), ("tx", "ty", "tz")


def sources(points: DataFrame, id_col: str = "point_id") -> DataFrame:
    return points.select(F.col(id_col).alias("source_id"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("z").alias("sz"))


def targets(points: DataFrame, id_col: str = "point_id") -> DataFrame:
    return points.select(F.col(id_col).alias("target_id"), F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("z").alias("tz"))


def _bucket(c: str, size: float) -> Column:
    return F.floor(F.col(c) / F.lit(size)).cast("long")


def _around(c: str, size: float) -> Column:
    return F.explode(F.sequence(_bucket(c, size) - 1, _bucket(c, size) + 1))


def near_pairs(s: DataFrame, t: DataFrame, reach: float, flat: bool = False, large_targets: bool = False) -> DataFrame:
    """All pairs of sources (source_id, sx, sy, sz, ...) and targets (target_id, tx, ty, tz, ...) with d2 = squared distance up to reach squared; flat: in x and y only (sz and tz may lack).

    If one side is small, each batch of the other meets it on the spot and nothing is shuffled; else the sides meet in buckets. A side
    is read up to the bound to find out, so sides that are dear to compute should be staged. large_targets: t is known to be no small side.
    """
    got = _by_index(s, t, reach, flat, large_targets)
    return _by_bucket(s, t, reach, flat) if got is None else got


def _by_index(s: DataFrame, t: DataFrame, reach: float, flat: bool = False, large_targets: bool = False) -> DataFrame | None:
    """near_pairs() where one side is small, else None."""
    if not (reach > 0 and math.isfinite(reach)):
        raise ValueError("the reach must be positive and finite")
    for small, large, a, b in ((t, s, XYZ_T, XYZ_S), (s, t, XYZ_S, XYZ_T))[large_targets:]:
        held = _held(small, a)
        if held:
            got = _met(held, small, large, b, reach, flat)
            return got.select(*s.columns, *t.columns, "d2")
    return None


def _by_bucket(s: DataFrame, t: DataFrame, reach: float, flat: bool = False) -> DataFrame:
    """near_pairs() of two large sides."""
    s, t = _placed(s, XYZ_S), _placed(t, XYZ_T)
    spread = s.withColumn("_bx", _around("sx", reach)).withColumn("_by", _around("sy", reach))
    placed = t.withColumns({"_bx": _bucket("tx", reach), "_by": _bucket("ty", reach)})
    dims = 2 if flat else 3
    met = spread.join(placed, ["_bx", "_by"]).withColumn("d2", squared_distance(XYZ_S[:dims], XYZ_T[:dims]))
    return met.where(F.col("d2") <= F.lit(reach * reach)).drop("_bx", "_by")


def _packed(df: DataFrame, id_col: str, xyz: tuple[str, ...], name: str) -> DataFrame:
    """(name, xyz): the rows at a place as one row, with their ids as structs (an id may be null), or as several where they are more than PACKED."""
    there = _placed(df, xyz)
    crowded = there.groupBy(*xyz).agg(F.ceil(F.count(F.lit(1)) / PACKED).cast("int").alias("_packs")).where(F.col("_packs") > 1)
    crowded = staged(crowded, "crowded")  # at most a row for each PACKED rows
    pack = F.pmod(F.xxhash64(id_col), F.coalesce("_packs", F.lit(1)))
    dealt = there.join(F.broadcast(crowded), list(xyz), "left").withColumn("_pack", pack)
    return dealt.groupBy(*xyz, "_pack").agg(F.collect_list(F.struct(id_col)).alias(name)).drop("_pack")


def pairs_within(source: DataFrame, target: DataFrame, reach: float, digits: int | None = None) -> DataFrame:
    """(source_id, target_id, distance) of all pairs up to reach, the reach included; distances rounded to so many digits, if told.

    Two large sides are compared place by place: what is shuffled grows with the points, and pairs of places become pairs of
    points after the last shuffle only, one after the other. They still are as many as they are.
    """
    s, t = sources(source), targets(target)
    distance = F.sqrt("d2") if digits is None else F.round(F.sqrt("d2"), digits)
    got = _by_index(s, t, reach)
    if got is not None:
        return got.select("source_id", "target_id", distance.alias("distance"))
    met = _by_bucket(_packed(s, "source_id", XYZ_S, "own"), _packed(t, "target_id", XYZ_T, "near"), reach)
    pairs = met.select("own", "near", distance.alias("distance")).select(F.explode("own").alias("s"), "near", "distance").select("s", F.explode("near").alias("t"), "distance")
    return pairs.select("s.source_id", "t.target_id", "distance")


def _places(df: DataFrame, xyz: tuple[str, ...]) -> list[str]:
    """The coordinate columns that are there."""
    return [c for c in xyz if c in df.columns]


def _placed(df: DataFrame, xyz: tuple[str, ...]) -> DataFrame:
    for c in _places(df, xyz):
        df = df.where(F.abs(F.col(c)) < F.lit(math.inf))
    return df


def _held(small: DataFrame, xyz: tuple[str, ...]) -> tuple[PointIndex, pa.Table] | None:
    """An index of a side's rows and the rows, if they are few."""
    there = _placed(small, xyz)
    if there.select(*_places(small, xyz)).limit(point_index.MOST + 1).count() > point_index.MOST:
        return None  # nothing of a large side comes to the driver
    got = there.limit(point_index.MOST + 1).toArrow()
    if not 0 < got.num_rows <= point_index.MOST or got.nbytes > point_index.MOST_BYTES:
        return None
    at = [got.column(c).to_numpy().astype(float) for c in _places(small, xyz)]
    return PointIndex(np.arange(got.num_rows), np.stack([*at, *[np.zeros(got.num_rows)] * (3 - len(at))], 1)), got


def _met(held: tuple[PointIndex, pa.Table], small: DataFrame, large: DataFrame, xyz: tuple[str, ...], reach: float, flat: bool) -> DataFrame:
    """Rows of the large side, each with the rows of the small one near it, and d2."""
    sent, places = large.sparkSession.sparkContext.broadcast(held), _places(large, xyz)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, rows = sent.value
        for b in batches:
            q = [b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float) for c in places]
            q = np.stack([*q, *[np.zeros(len(b))] * (3 - len(q))], 1)
            for query, point, d2 in index.within(q, reach, flat):
                own, near = b.take(pa.array(query)), rows.take(pa.array(index.ids[point])).combine_chunks().to_batches()
                if near:
                    yield pa.RecordBatch.from_arrays([*own.columns, *near[0].columns, pa.array(d2)], [*own.schema.names, *near[0].schema.names, "d2"])

    schema = StructType([*large.schema.fields, *small.schema.fields, StructField("d2", DoubleType())])
    return _placed(large, xyz).mapInArrow(run, schema)


def nearest_places(s: DataFrame, t: DataFrame, reach: float) -> DataFrame:
    """s (source_id, sx, sy, sz, ...) with target_id, d2, tx, ty, tz of the nearest target up to reach; ties to the least id."""
    kind = t.schema["target_id"].dataType.simpleString()
    got, split = around.fold(s, t, reach, around.nearest_of(reach), f"target_id {kind}, d2 double, rank int, tx double, ty double, tz double")
    got = got.drop("rank")
    if not split:
        return got
    best = got.groupBy(*s.columns).agg(F.min(F.struct("d2", "target_id", "tx", "ty", "tz")).alias("m"))  # a row for each part of a tile
    return best.select(*s.columns, *(F.col(f"m.{c}").alias(c) for c in ("target_id", "d2", "tx", "ty", "tz")))


def nearest_within(source: DataFrame, target: DataFrame, reach: float, keep_all: bool = False) -> DataFrame:
    """(source_id, target_id, distance): the nearest target up to reach; ties to the least id. keep_all: sources without one too, with nulls."""
    best = nearest_places(sources(source), targets(target), reach).select("source_id", "target_id", F.sqrt("d2").alias("distance"))
    if not keep_all:
        return best
    return source.select(F.col("point_id").alias("source_id")).join(best, "source_id", "left")


def _extent(source: DataFrame, target: DataFrame) -> float:
    """A distance that no source and target exceed."""
    box = [f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]
    t, s = target.agg(*box).first(), source.agg(*box).first()
    if t["lo_x"] is None or s["lo_x"] is None:
        raise ValueError("point clouds must not be empty")
    sides = [max(s[f"hi_{c}"], t[f"hi_{c}"]) - min(s[f"lo_{c}"], t[f"lo_{c}"]) for c in "xyz"]
    return math.sqrt(sum(v * v for v in sides)) + 1e-9


def knn(source: DataFrame, target: DataFrame, k: int, start: float | None = None, extent: float | None = None, most: int = 40) -> DataFrame:
    """(source_id, target_id, distance, rank, tx, ty, tz): the k nearest targets of every source, all of them if there are fewer.

    A target of few points is broadcast as an index. Else sources and targets meet over a quadtree of the target, in two rounds. If `start` is given, the search starts with that reach instead and triples it for
    sources that don't have k within reach; `extent` is the largest distance that can occur, beyond which nothing is missed. A source that is a target is its own neighbour.
    """
    if k < 1:
        raise ValueError("k must be 1 at least")
    index = index_of(target)
    if index:
        return matches(source, index, k).select("source_id", "target_id", F.sqrt("d2").alias("distance"), "rank", "tx", "ty", "tz")
    if start is None:
        found = quadtree.nearest(sources(source), targets(target), k)
        return found.select("source_id", "target_id", F.sqrt("d2").alias("distance"), "rank", "tx", "ty", "tz")
    extent = extent or _extent(source, target)
    s, t = sources(source), staged(targets(target), "targets")
    out, left, reach = None, staged(s, "sources"), start
    for _ in range(most):
        few = index_of(left.select("source_id", F.col("sx").alias("x"), F.col("sy").alias("y"), F.col("sz").alias("z")), "source_id", LONELY)
        if few and reach > start:  # the last ones see the whole target once, instead of ever larger buckets
            got = _nearest_to_few(few, t, k)
            return got if out is None else out.unionByName(got)
        last = reach >= extent
        got, split = around.fold(left, t, reach, around.nearest_of(reach, k, counted=True), f"target_id {t.schema['target_id'].dataType.simpleString()}, d2 double, rank int, tx double, ty double, tz double, found int", copies=k)
        if split:  # a tile's parts have k each
            own = Window.partitionBy("source_id", *XYZ_S)
            got = got.withColumn("rank", F.row_number().over(own.orderBy("d2", "target_id"))).where(F.col("rank") <= k).withColumn("found", F.max("rank").over(own))
        place = [F.when(F.col("rank") == k, F.col(c)).alias(c) for c in XYZ_S]  # once a source
        got = staged(got.select("source_id", "target_id", F.sqrt("d2").alias("distance"), "rank", "tx", "ty", "tz", "found", *place), "near")
        if not last:  # a source with k neighbours in reach is done: its rows say so, and only the sources meet in a join
            before, left = left, staged(left.join(got.where(F.col("rank") == k), ["source_id", *XYZ_S], "left_anti"), "sources")
            unstage(before)
            got = got.where(F.col("source_id").isNotNull() & (F.col("found") == k))
        got = got.drop("found", *XYZ_S)
        out = got if out is None else out.unionByName(got)
        if last or left.limit(1).count() == 0:
            return out
        reach *= 3
    raise RuntimeError("the reach never came to the extent")


def _nearest_to_few(few: PointIndex, target: DataFrame, k: int) -> DataFrame:
    """knn() of the index's points: one pass over targets, each task keeping k for each of them, then the k best of those.

    Tasks don't compare all with all: a batch of targets is dealt over the cells of an index of its own.
    """
    held = target.sparkSession.sparkContext.broadcast((few.ids, few.xyz))
    names = ["source_id", "d2", "target_id", "tx", "ty", "tz"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, xyz = held.value
        best = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros((0, 3)))
        for b in batches:
            own = PointIndex(b.column(0).to_numpy(), queries_of(b))
            query, _, point, d2 = own.nearest(xyz, k)
            q, d, t, at = (np.concatenate(x) for x in zip(best, (query, d2, own.ids[point], own.xyz[point]), strict=True))
            by = np.lexsort((t, d, q))
            by = by[np.arange(len(by)) - np.searchsorted(q[by], q[by]) < k]
            best = q[by], d[by], t[by], at[by]
        q, d, t, at = best
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(d), pa.array(t), *(pa.array(at[:, i]) for i in range(3))], names)

    order = Window.partitionBy("source_id").orderBy("d2", "target_id")
    offered = target.where("tx IS NOT NULL AND ty IS NOT NULL AND tz IS NOT NULL").mapInArrow(run, "source_id long, d2 double, target_id long, tx double, ty double, tz double")
    ranked = offered.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("source_id", "target_id", F.sqrt("d2").alias("distance"), "rank", "tx", "ty", "tz")


def counts_within(source: DataFrame, target: DataFrame, reach: float) -> DataFrame:
    """(source_id, n) of sources that have a target within reach."""
    got, _ = around.fold(sources(source), targets(target), reach, around.counts_of(reach), "n long", added=True)
    return got.groupBy("source_id").agg(F.sum("n").alias("n"))


def moments_within(source: DataFrame, target: DataFrame, reach: float, nearest: bool = False) -> DataFrame:
    """(source_id, sx, sy, sz, n, mx .. zz): counts, means and centred second moments of every source's targets up to reach, relative to the source. nearest: and the nearest one's target_id."""
    t = targets(target)
    sums, more = around.MOMENT_SUMS, f", target_id {t.schema['target_id'].dataType.simpleString()}, d2 double" if nearest else ""
    got, _ = around.fold(sources(source), t, reach, around.moments_of(reach, nearest), ", ".join(f"{c} double" for c in sums) + more, added=True)
    by = ["source_id", *XYZ_S]
    near = [F.min(F.struct("d2", "target_id")).alias("near")] if nearest else []  # a row a source goes in, or one for each part of a tile
    m = got.groupBy(*by).agg(*(F.sum(c).alias(c) for c in sums), *near)
    mean = {f"m{c}": F.col(f"m{c}") / F.col("n") for c in "xyz"}
    spread = {c: F.col(c) / F.col("n") - mean[f"m{c[0]}"] * mean[f"m{c[1]}"] for c in sums[4:]}
    more = [F.col("near.target_id").alias("target_id")] if nearest else []
    return m.select(*by, F.col("n").cast("long").alias("n"), *(e.alias(c) for c, e in (mean | spread).items()), *more)
