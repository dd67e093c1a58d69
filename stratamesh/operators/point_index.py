"""A grid index over a bounded number of points, small enough to be sent to every executor."""

from __future__ import annotations

import contextlib
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points that an index holds at most: 24 MB of coordinates, ids and cells. Larger clouds meet in joins by bucket.
MOST = 500_000
#: Points to a cell on average, and candidates that are compared at once.
_PER_CELL, _AT_ONCE = 3, 1_000_000
#: Candidates that a query of the nearest points is compared with in its cells, about, at most; points to a leaf of the tree that it goes down else.
_FEW, _LEAF = 64, 16
#: Bytes of a side's columns that may be sent to every executor.
MOST_BYTES = 64 << 20
#: Rows that have a place.
FINITE = " AND ".join(f"abs({c}) < double('infinity')" for c in "xyz")


@contextlib.contextmanager
def held_at_most(points: int) -> Iterator[None]:
    """Plans made inside hold no side of more points in an index; with 0, all sides meet in joins by bucket."""
    global MOST
    before, MOST = MOST, points
    try:
        yield
    finally:
        MOST = before


class PointIndex:
    """Points dealt over cells of x and y, row by row, so that neighbouring cells of a row are one range."""

    def __init__(self, ids: np.ndarray, xyz: np.ndarray):
        self.low = xyz[:, :2].min(0)
        size = xyz[:, :2].max(0) - self.low
        self.cell = max(math.sqrt(max(size[0] * size[1], 0.0) * _PER_CELL / len(ids)), size.max() / 2000, 1e-9)
        self.n = (size // self.cell).astype(np.int64) + 1
        at = self._cells(xyz[:, 0], xyz[:, 1])
        key = at[1] * self.n[0] + at[0]
        order = np.lexsort((ids, key))
        self.ids, self.xyz = ids[order], xyz[order]
        self.first = np.searchsorted(key[order], np.arange(self.n[0] * self.n[1] + 1))
        self.tree: Tree | None = None  # made where it is needed first

    def _cells(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        return [np.clip((v - self.low[i]) // self.cell, 0, self.n[i] - 1).astype(np.int64) for i, v in enumerate((x, y))]

    def _safe(self, q: np.ndarray, cx: np.ndarray, cy: np.ndarray, ring: int) -> np.ndarray:
        """How far from each query nothing lies outside its block of cells."""
        out = np.full(len(q), math.inf)
        for i, c in enumerate((cx, cy)):
            before, after = q[:, i] - (self.low[i] + (c - ring) * self.cell), self.low[i] + (c + ring + 1) * self.cell - q[:, i]
            out = np.minimum(out, np.where(c - ring > 0, before, math.inf))
            out = np.minimum(out, np.where(c + ring + 1 < self.n[i], after, math.inf))
        return out

    def _count(self, cx: np.ndarray, cy: np.ndarray, ring: int) -> np.ndarray:
        """How many points are in each query's block."""
        total = np.zeros(len(cx), np.int64)
        for i in range(-ring, ring + 1):
            there = (cy + i >= 0) & (cy + i < self.n[1])
            base = np.where(there, cy + i, 0) * self.n[0]
            total += np.where(there, self.first[base + np.minimum(cx + ring, self.n[0] - 1) + 1] - self.first[base + np.maximum(cx - ring, 0)], 0)
        return total

    def _block(self, q: np.ndarray, cx: np.ndarray, cy: np.ndarray, ring: int, flat: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, point, squared distance) of all points in each query's block."""
        rows = cy[:, None] + np.arange(-ring, ring + 1)
        there = (rows >= 0) & (rows < self.n[1])
        base = np.where(there, rows, 0) * self.n[0]
        start = self.first[base + np.maximum(cx - ring, 0)[:, None]]
        end = np.where(there, self.first[base + np.minimum(cx + ring, self.n[0] - 1)[:, None] + 1], start)
        count = np.where(there, end - start, 0).ravel()
        start = start.ravel()
        point = np.arange(count.sum()) + np.repeat(start - (np.cumsum(count) - count), count)
        query = np.repeat(np.repeat(np.arange(len(q)), rows.shape[1]), count)
        d = self.xyz[point] - q[query]
        d2 = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1]
        return query, point, d2 if flat else d2 + d[:, 2] * d[:, 2]

    def _slices(self, cx: np.ndarray, cy: np.ndarray, ring: int) -> Iterator[slice]:
        """Ranges of queries with some _AT_ONCE points in their blocks together, or one query each."""
        rows = cy[:, None] + np.arange(-ring, ring + 1) if len(cy) * (2 * ring + 1) <= _AT_ONCE else None
        if rows is None:  # too many to count at once
            half = len(cy) // 2
            for lo, hi in ((0, half), (half, len(cy))) if half else ():
                yield from (slice(lo + s.start, lo + s.stop) for s in self._slices(cx[lo:hi], cy[lo:hi], ring))
            if not half and len(cy):
                yield slice(0, 1)
            return
        there = (rows >= 0) & (rows < self.n[1])
        base = np.where(there, rows, 0) * self.n[0]
        count = self.first[base + np.minimum(cx + ring, self.n[0] - 1)[:, None] + 1] - self.first[base + np.maximum(cx - ring, 0)[:, None]]
        upto = np.cumsum(np.where(there, count, 0).sum(1))
        lo = 0
        while lo < len(cy):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + _AT_ONCE, "right")))
            yield slice(lo, hi)
            lo = hi

    def within(self, q: np.ndarray, reach: float, flat: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, point, squared distance) of all pairs up to reach, in blocks of bounded size; flat: in x and y only."""
        ring = min(math.ceil(reach / self.cell), int(self.n.max()))
        cx, cy = self._cells(q[:, 0], q[:, 1])
        for own in self._slices(cx, cy, ring):
            query, point, d2 = self._block(q[own], cx[own], cy[own], ring, flat)
            near = d2 <= reach * reach
            yield query[near] + own.start, point[near], d2[near]

    def nearest(self, q: np.ndarray, k: int, reach: float = math.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, rank from 1, point, squared distance) of the k nearest points up to reach of every query; ties to the least id.

        Cells are of x and y. A query is done if its block of 3 x 3 or 5 x 5 cells says enough and isn't crowded; the others go down a tree, so what is
        tested for them grows neither with the points above and below nor with those at crowded places.
        """
        got, left, hard = [], np.arange(len(q)), []
        cx, cy = self._cells(q[:, 0], q[:, 1])
        for ring in (1, 2):
            simple = self._count(cx[left], cy[left], ring) <= (_FEW + _PER_CELL * k) * ring
            hard.append(left[~simple])
            live, later = left[simple], [left[:0]]
            for some in self._slices(cx[live], cy[live], ring):
                own = live[some]
                query, point, d2 = self._block(q[own], cx[own], cy[own], ring)
                safe = self._safe(q[own], cx[own], cy[own], ring)
                sure = (d2 < (safe * safe)[query]) & (d2 <= reach * reach)  # nothing outside the block comes before these
                query, point, d2 = query[sure], point[sure], d2[sure]
                done = (np.bincount(query, minlength=len(own)) >= k) | (safe > reach) | np.isinf(safe)
                last = done[query]  # the others' are looked for again
                got.append((own[query[last]], point[last], d2[last]))
                later.append(own[~done])
            left = np.concatenate(later)
        hard = np.concatenate([*hard, left])
        if len(hard):
            self.tree = self.tree or Tree(self.xyz)
            got += [(hard[query], point, d2) for query, point, d2 in self.tree.candidates(q[hard], k, reach)]
        if not got:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
        best = []
        for query, point, d2 in got:
            order = np.lexsort((self.ids[point], d2, query))
            query, point, d2 = query[order], point[order], d2[order]
            rank = np.arange(len(query)) - np.searchsorted(query, query) + 1
            keep = rank <= k
            best.append((query[keep], rank[keep], point[keep], d2[keep]))
        return tuple(np.concatenate(x) for x in zip(*best, strict=True))


class Tree:
    """Points halved along their widest side until some `leaf` are left, with the box around each part. Part i of a level is dealt into parts 2 i and 2 i + 1 of the next."""

    def __init__(self, xyz: np.ndarray, leaf: int = _LEAF):
        n = len(xyz)
        levels = max(0, math.ceil(math.log2(n / leaf)))
        self.start = [n * np.arange(2**level + 1) >> level for level in range(levels + 1)]
        order = np.arange(n)
        for start in self.start[:-1]:
            own, part = xyz[order], np.repeat(np.arange(len(start) - 1), np.diff(start))
            wide = (np.maximum.reduceat(own, start[:-1]) - np.minimum.reduceat(own, start[:-1])).argmax(1)
            order = order[np.lexsort((own[np.arange(n), wide[part]], part))]
        self.point, self.xyz = order, xyz[order]
        boxes = [tuple(f.reduceat(self.xyz, self.start[-1][:-1]) for f in (np.minimum, np.maximum))]
        for _ in range(levels):
            low, high = boxes[-1]
            boxes.append((np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])))
        self.boxes = boxes[::-1]

    def _near(self, level: int, part: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Squared distance to the part's box: rounded as distances to points are, so never above that of a point inside."""
        low, high = self.boxes[level]
        d = np.maximum(np.maximum(low[part] - q, q - high[part]), 0.0)
        return d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]

    def _inside(self, level: int, part: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, squared distance), a row for each q: all points of its part, no number beyond the part's end."""
        first, end = self.start[level][part], self.start[level][part + 1]
        at = first[:, None] + np.arange((end - first).max())
        there = at < end[:, None]
        at = np.where(there, at, 0)
        d = self.xyz[at] - q[:, None]
        d2 = d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2]
        return at, np.where(there, d2, math.nan)

    def candidates(self, q: np.ndarray, k: int, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, point, squared distance) with the k nearest points up to reach of every query, and all that are as near as the last of them; a query's rows come together."""
        k, levels = min(k, len(self.xyz)), len(self.start) - 1
        deep = min(levels, int(math.log2(len(self.xyz) // k)))  # parts of this level have k points at least
        todo = [slice(i, i + _AT_ONCE // 128) for i in range(0, len(q), _AT_ONCE // 128)]
        if k > _LEAF:
            todo = [slice(i, i + max(1, _AT_ONCE // (4 * k))) for i in range(0, len(q), max(1, _AT_ONCE // (4 * k)))]
        while todo:
            some = todo.pop()
            own = q[some]
            part = np.zeros(len(own), np.int64)
            for level in range(1, deep + 1):
                part = 2 * part + (self._near(level, 2 * part + 1, own) < self._near(level, 2 * part, own))
            _, d2 = self._inside(deep, part, own)
            bound = np.minimum(np.partition(d2, k - 1, 1)[:, k - 1], reach * reach)
            query, part = np.arange(len(own)), np.zeros(len(own), np.int64)
            for level in range(1, levels + 1):
                query, part = np.repeat(query, 2), np.repeat(2 * part, 2) + np.tile([0, 1], len(part))
                keep = self._near(level, part, own[query]) <= bound[query]
                query, part = query[keep], part[keep]
                if len(query) * _LEAF > 4 * _AT_ONCE and len(own) > 1:
                    break
            if len(query) * _LEAF > 4 * _AT_ONCE and len(own) > 1:  # too many to compare at once
                half = some.start + len(own) // 2
                todo += [slice(some.start, half), slice(half, some.start + len(own))]
                continue
            if len(query):
                at, d2 = self._inside(levels, part, own[query])
                near = d2 <= bound[query, None]
                yield np.repeat(query, near.sum(1)) + some.start, self.point[at[near]], d2[near]


def index_of(points: DataFrame, id_col: str = "point_id", most: int | None = None) -> PointIndex | None:
    """The index of at most `most` points (id, x, y, z; MOST if not told otherwise); None of more of them, of none, or if ids aren't whole numbers. Points without all coordinates are let go."""
    if points.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        return None
    most = MOST if most is None else most
    there = points.select(F.col(id_col).cast("long").alias("i"), *(F.col(c).cast("double").alias(c) for c in "xyz")).where("i IS NOT NULL").where(FINITE)
    got = there.limit(most + 1).toArrow()
    if not 0 < got.num_rows <= most:
        return None
    return PointIndex(got.column("i").to_numpy(), np.stack([got.column(c).to_numpy() for c in "xyz"], 1))


def queries_of(batch) -> np.ndarray:
    """x, y and z of an Arrow batch (id, x, y, z, ...) as rows."""
    return np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3)], 1).astype(float)


def matches(source: DataFrame, index: PointIndex, k: int, reach: float = math.inf, id_col: str = "point_id") -> DataFrame:
    """(source_id, target_id, d2, rank, tx, ty, tz): the k nearest points of the index up to reach of every source. No shuffle."""
    import pyarrow as pa

    held = source.sparkSession.sparkContext.broadcast(index)
    names = ["source_id", "target_id", "d2", "rank", "tx", "ty", "tz"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for b in batches:
            query, rank, point, d2 = own.nearest(queries_of(b), k, reach)
            arrays = [b.column(0).take(pa.array(query)), pa.array(own.ids[point]), pa.array(d2), pa.array(rank.astype(np.int32)), *(pa.array(own.xyz[point, i]) for i in range(3))]
            yield pa.RecordBatch.from_arrays(arrays, names)

    rows = source.select(F.col(id_col).alias("i"), *(F.col(c).cast("double").alias(c) for c in "xyz")).where(FINITE)
    kind = source.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"source_id {kind}, target_id long, d2 double, rank int, tx double, ty double, tz double")
