"""Nearest neighbours of two large clouds over a quadtree of the target: crowded places have small leaves, and a search visits those leaves only that can matter.

The tree is made of counts and boxes by Morton prefix, aggregated in Spark; only overfull places are counted again, more finely. Its
size is bounded whatever the cloud holds, so every task has it. Points stay in Spark: sources and targets meet by leaf.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratamesh.functions.geometry import Bounds
from stratamesh.operators.point_index import PointIndex
from stratamesh.sources.layout import BITS, morton_key
from stratamesh.staging import staged, unstage

#: Targets that a leaf holds, and leaves that are divided further, at most: a cloud beyond their product has fuller leaves.
LEAF, DIVIDED = 50_000, 1 << 14
#: Rows of each side that meet in one group; leaves with more are dealt over several.
GROUP = 50_000
#: Sources are asked for once a place if they have at most this share of places.
COPIES = 0.7
#: The level that is counted first (65,536 cells at most), and sources that go down the tree at once.
_FIRST, _AT_ONCE = 8, 2_000
_FINITE = "abs({0}x) < double('infinity') AND abs({0}y) < double('infinity') AND abs({0}z) < double('infinity')"


class Quadtree:
    """Nodes level by level, each with its number of points and the box around them; children of a node follow each other."""

    def __init__(self, cells: dict[int, tuple[np.ndarray, ...]], most: int):
        """cells: level -> (Morton prefix, points, least coordinates, greatest coordinates) of disjoint cells that hold all points."""
        levels, below = [], None
        for level in range(max(cells), -1, -1):
            parts = []
            if below is not None:
                key, at = np.unique(below[0] >> 2, return_index=True)
                kids = np.diff(np.append(at, len(below[0])))
                parts.append((key, np.add.reduceat(below[1], at), np.minimum.reduceat(below[2], at), np.maximum.reduceat(below[3], at), at, kids))
            if level in cells:
                none = np.zeros(len(cells[level][0]), np.int64)
                parts.append((*cells[level], none, none))
            merged = [np.concatenate(x) for x in zip(*parts, strict=True)]
            order = np.argsort(merged[0])
            below = [x[order] for x in merged]
            levels.append((level, below))
        levels.reverse()
        start = np.cumsum([0, *(len(b[0]) for _, b in levels)])
        self.n, self.low, self.high = (np.concatenate([b[i] for _, b in levels]) for i in (1, 2, 3))
        self.kids = np.concatenate([b[5] for _, b in levels])
        self.first = np.concatenate([b[4] + start[i + 1] for i, (_, b) in enumerate(levels)])
        self.leaf = (self.kids == 0) | (self.n <= most)
        node = np.zeros(1, np.int64)
        while not self.leaf[node].all():
            _, node = self._opened(node, node)
        begins = np.concatenate([b[0] << (2 * (BITS - level)) for level, b in levels])[node]
        order = np.argsort(begins)
        self.begins, self.leaves = begins[order], node[order]

    def leaf_at(self, key: np.ndarray) -> np.ndarray:
        """The leaf that holds a point of the tree's cloud, by its Morton key."""
        return self.leaves[np.searchsorted(self.begins, key, "right") - 1]

    def _opened(self, query: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves stay, other nodes give way to their children."""
        many, first = np.where(self.leaf[node], 1, self.kids[node]), np.where(self.leaf[node], node, self.first[node])
        return np.repeat(query, many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)

    def _near(self, q: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Squared distance to the box: rounded as distances to points are, so never above that of a point inside."""
        d = np.maximum(np.maximum(self.low[node] - q, q - self.high[node]), 0.0)
        return d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]

    def _far(self, q: np.ndarray, node: np.ndarray) -> np.ndarray:
        d = np.maximum(np.abs(q - self.low[node]), np.abs(self.high[node] - q))
        return d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]

    def first_leaf(self, q: np.ndarray, k: int, within2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, leaf, squared distance): the leaf to look at first, and a distance within which k points are known to lie. Queries with nothing within2 are left out."""
        query, node = np.arange(len(q)), np.zeros(len(q), np.int64)
        bound = np.full(len(q), within2)
        while True:
            near, far = self._near(q[query], node), self._far(q[query], node)
            order = np.lexsort((far, query))
            query, node, near, far = query[order], node[order], near[order], far[order]
            begin = np.searchsorted(query, query)
            seen = np.cumsum(self.n[node])
            seen = seen - (seen[begin] - self.n[node][begin])  # points in nodes up to this one, of the same query
            enough = np.flatnonzero(seen >= k)
            np.minimum.at(bound, query[enough], far[enough])
            keep = near <= bound[query]
            query, node = query[keep], node[keep]
            if self.leaf[node].all():
                order = np.lexsort((far[keep], near[keep], query))  # a source's own place first, whatever its leaf's height
                query, node = query[order], node[order]
                own = np.flatnonzero(np.diff(query, prepend=-1))
                return query[own], node[own], bound[query[own]]
            query, node = self._opened(query, node)

    def leaves_within(self, q: np.ndarray, within2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) of all leaves whose boxes are within a squared distance of each query."""
        query, node = np.arange(len(q)), np.zeros(len(q), np.int64)
        while True:
            keep = self._near(q[query], node) <= within2[query]
            query, node = query[keep], node[keep]
            if self.leaf[node].all():
                return query, node
            query, node = self._opened(query, node)


def tree_of(target: DataFrame, most: int = LEAF) -> tuple[Quadtree, Bounds]:
    """The tree of targets (tx, ty, tz, all finite) and the box its keys are of. ValueError without targets.

    One pass finds the box and one counts 65,536 cells; further ones look at points of overfull cells only, at most 262,144 rows a pass.
    """
    ends = [f(f"t{c}") for c in "xy" for f in (F.min, F.max)]
    n, x0, x1, y0, y1 = target.agg(F.count(F.lit(1)), *ends).first()
    if not n:
        raise ValueError("point clouds must not be empty")
    b = Bounds(x0, y0, x1, y1)
    most = max(most, n // DIVIDED)
    keyed = target.select("tx", "ty", "tz", morton_key(b, "tx", "ty").alias("m"))
    cells, level, rest = {}, _FIRST, keyed
    while True:
        boxes = [f(f"t{c}").alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in "xyz"]
        got = rest.groupBy(F.shiftright("m", 2 * (BITS - level)).alias("key")).agg(F.count(F.lit(1)).alias("n"), *boxes).toArrow()
        key, count, *sides = (got.column(i).to_numpy() for i in range(8))
        low, high = np.stack(sides[:3], 1), np.stack(sides[3:], 1)
        full = count > most
        if level == BITS:
            full[:] = False
        cells[level] = tuple(a[~full] for a in (key, count, low, high))
        if not full.any():
            return Quadtree({at: c for at, c in cells.items() if len(c[0])}, most), b
        hot = target.sparkSession.createDataFrame(pa.table({"hot": key[full]}))  # at most n / most rows
        rest = keyed.join(F.broadcast(hot), F.shiftright("m", 2 * (BITS - level)) == F.col("hot"), "left_semi")
        level = min(BITS, level + (4 if full.sum() <= 1024 else 2))


def _rows(batch: pa.RecordBatch, *names: str) -> np.ndarray:
    return np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float) for c in names], 1)


def _with(batch: pa.RecordBatch, at: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """Rows of the batch at places, with further columns."""
    own = batch.take(pa.array(at))
    return pa.RecordBatch.from_arrays([*own.columns, *map(pa.array, columns.values())], [*own.schema.names, *columns])


def _meet(asked: DataFrame, placed: DataFrame, k: int, reach: float, group: int) -> DataFrame:
    """(source_id, target_id, d2, tx, ty, tz): of sources (.., leaf, part) the k nearest targets up to reach in each group of targets (.., leaf, part).

    Groups with more than `group` sources are dealt over several by the hash of the id, their targets copied to each.
    """
    counts = asked.groupBy("leaf", "part").agg(F.ceil(F.count(F.lit(1)) / group).cast("int").alias("shares"))
    counts = F.broadcast(counts)  # a row a group of the bounded tree
    s = asked.join(counts, ["leaf", "part"]).withColumn("share", F.pmod(F.xxhash64("source_id", "sx", "sy", "sz"), F.col("shares")).cast("int"))
    t = placed.join(counts, ["leaf", "part"]).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    by = ["leaf", "part", "share"]
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((asked, "source_id"), (placed, "target_id"))}

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["source_id", "target_id", "d2", "tx", "ty", "tz"]
        query, point, d2 = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        order = np.zeros(0, np.int64)
        if left.num_rows and right.num_rows:
            xyz = np.stack([right.column(c).to_numpy().astype(float) for c in ("tx", "ty", "tz")], 1)
            ids = right.column("target_id").to_numpy()
            order = np.argsort(ids, kind="stable")  # places in the order of ids stand for ids of any kind
            own = PointIndex(np.arange(len(order)), xyz[order])
            query, _, point, d2 = own.nearest(np.stack([left.column(c).to_numpy().astype(float) for c in ("sx", "sy", "sz")], 1), k, reach)
            point = own.ids[point]
        found = right.take(pa.array(order[point]))
        columns = [left.column("source_id").take(pa.array(query)), found.column("target_id"), pa.array(d2), *(found.column(c).cast("double") for c in names[3:])]
        return pa.Table.from_arrays(columns, names)

    s, t = s.select("source_id", "sx", "sy", "sz", *by), t.select("target_id", "tx", "ty", "tz", *by)
    return s.groupBy(*by).cogroup(t.groupBy(*by)).applyInArrow(best, f"source_id {kinds['source_id']}, target_id {kinds['target_id']}, d2 double, tx double, ty double, tz double")


def nearest(s: DataFrame, t: DataFrame, k: int, reach: float = math.inf, leaf: int = LEAF, group: int = GROUP) -> DataFrame:
    """(source_id, target_id, d2, rank, tx, ty, tz): the k nearest targets (target_id, tx, ty, tz) up to reach of every source (source_id, sx, sy, sz), ties to the least id.

    Two rounds: a source meets the leaf that promises most, then those other leaves that are nearer than its k-th neighbour so far, few for most
    sources. Leaves divide x and y only: points piled up in z over a place narrower than their distances are compared with each other in groups. Points without all (finite) coordinates meet nobody; a source's rows should be one; targets' repeated rows count each. ValueError without targets.
    """
    spark = s.sparkSession
    s = s.where(_FINITE.format("s")).select("source_id", "sx", "sy", "sz")
    places = staged(s.groupBy("sx", "sy", "sz").agg(F.min("source_id").alias("source_id")).select("source_id", "sx", "sy", "sz"), "places")
    if places.count() <= COPIES * s.count():  # sources at one place have the same neighbours
        found = nearest_of_places(places, t, k, reach, leaf, group)
        members = s.join(places.withColumnRenamed("source_id", "place"), ["sx", "sy", "sz"]).select("source_id", "place")
        return members.join(found.withColumnRenamed("source_id", "place"), "place").drop("place")
    unstage(places)
    return nearest_of_places(s, t, k, reach, leaf, group)


def nearest_of_places(s: DataFrame, t: DataFrame, k: int, reach: float, leaf: int, group: int) -> DataFrame:
    """nearest() of sources that all have coordinates, each asked for itself. Of targets at one place the k with the least ids can be among the nearest."""
    spark = s.sparkSession
    copy = Window.partitionBy("tx", "ty", "tz").orderBy("target_id")
    t = t.where(_FINITE.format("t")).select("target_id", "tx", "ty", "tz").withColumn("copy", F.row_number().over(copy)).where(F.col("copy") <= k).drop("copy")
    held = staged(t, "targets")
    tree, b = tree_of(held, leaf)
    sent, parts = spark.sparkContext.broadcast(tree), -(-tree.n // group)
    fields = lambda df: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = sent.value.leaf_at(batch.column(batch.schema.get_field_index("m")).to_numpy())
            deal = batch.column(batch.schema.get_field_index("h")).to_numpy() % parts[at]
            yield _with(batch, np.arange(len(at)), leaf=at, part=deal)

    def dealt(batch: pa.RecordBatch, query: np.ndarray, node: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
        """A row for every part of each query's leaf."""
        many = parts[node]
        again = np.repeat(np.arange(len(node)), many)
        part = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return _with(batch, query[again], **{c: v[again] for c, v in more.items()}, leaf=node[again], part=part)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), _AT_ONCE):
                own = batch.slice(lo, _AT_ONCE)
                query, node, bound = sent.value.first_leaf(_rows(own, "sx", "sy", "sz"), k, reach * reach)
                yield dealt(own, query, node, bound=bound)

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), _AT_ONCE):
                own = batch.slice(lo, _AT_ONCE)
                query, node = sent.value.leaves_within(_rows(own, "sx", "sy", "sz"), _rows(own, "bound")[:, 0])
                other = node != own.column(own.schema.get_field_index("been")).to_numpy()[query]
                yield dealt(own, query[other], node[other])

    keyed = held.withColumns({"m": morton_key(b, "tx", "ty"), "h": F.pmod(F.xxhash64("target_id", "tx", "ty", "tz"), F.lit(1 << 40))})
    placed = keyed.mapInArrow(place, f"{fields(keyed)}, leaf long, part long")
    first = staged(s.select("source_id", "sx", "sy", "sz").mapInArrow(begin, f"{fields(s.select('source_id', 'sx', 'sy', 'sz'))}, bound double, leaf long, part long"), "first")
    met = staged(_meet(first, placed, k, reach, group), "met")
    order = Window.partitionBy("source_id").orderBy("d2", "target_id")
    last = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("source_id", F.col("d2").alias("last"))
    open_ = first.where("part = 0").join(last, "source_id", "left").select("source_id", "sx", "sy", "sz", F.least("bound", "last").alias("bound"), F.col("leaf").alias("been"))
    second = staged(open_.mapInArrow(go_on, f"{fields(open_)}, leaf long, part long"), "second")
    ranked = met.unionByName(_meet(second, placed, k, reach, group)).withColumn("rank", F.row_number().over(order))
    out = staged(ranked.where(F.col("rank") <= k).select("source_id", "target_id", "d2", "rank", "tx", "ty", "tz"), "nearest")
    unstage(held, first, met, second)
    return out
