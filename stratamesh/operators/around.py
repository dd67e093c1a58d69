"""Sources meet the targets around them, and a row a source comes back, however many targets it has.

Pairs live inside a batch or a tile only: nothing that is as long as the pairs is sorted, shuffled or written. Targets at one
place (repeated scans, copies) count as one with a weight, and so do sources while they are compared.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stratamesh.operators import point_index
from stratamesh.operators.point_index import PointIndex
from stratamesh.operators.range_sums import COLUMNS, Region, SumTree
from stratamesh.staging import staged

#: Rows of each side that meet in one group at most: fuller tiles are dealt over several.
ROWS = 100_000
#: So many times as many rows of each side where sums are asked for, whose time grows little with the targets.
SUMMED = 4
#: Tiles that a cloud is divided into at least, if it is wide enough for them and has a thousand points for each.
TILES = 256
PLACE_S, PLACE_T = ("sx", "sy", "sz"), ("tx", "ty", "tz")
_FINITE = "abs({0}x) < double('infinity') AND abs({0}y) < double('infinity') AND abs({0}z) < double('infinity')"

Kernel = Callable[["Sites", np.ndarray], tuple[np.ndarray, list]]


class Sites:
    """The places of targets: an index of them, their ids, how many rows stand there (n), and their side, if they have one."""

    def __init__(self, rows: pa.Table, copies: int = 1):
        """rows: (target_id, tx, ty, tz, and n and side, if there). Of targets at one place the `copies` with the least ids stay."""
        xyz = np.stack([rows.column(c).to_numpy().astype(float) for c in PLACE_T], 1)
        ids = rows.column("target_id")
        by = np.argsort(ids.to_numpy(), kind="stable")
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        names = rows.column_names
        side = rows.column("side").to_numpy() if "side" in names else np.zeros(len(by), np.int32)
        n = rows.column("n").to_numpy().astype(float) if "n" in names else np.ones(len(by))
        order = np.lexsort((rank, side, *xyz.T))
        own = np.column_stack([xyz, side])[order]
        first = np.concatenate([[True], (own[1:] != own[:-1]).any(1)])
        start = np.flatnonzero(first)
        keep = np.arange(len(by)) - np.repeat(start, np.diff(np.append(start, len(by)))) < copies
        weight = np.add.reduceat(n[order], start)[np.cumsum(first) - 1]
        places = order[keep]
        least = np.argsort(rank[places], kind="stable")  # in the order of ids, which may be of any kind
        places = places[least]
        self.n, self.side, self.ids = weight[keep][least], side[places], ids.take(pa.array(places)).combine_chunks()
        self.xyz, self._made = xyz[places], {}  # what is asked of them is made where it is needed first

    @property
    def index(self) -> PointIndex:
        if "index" not in self._made:
            self._made["index"] = PointIndex(np.arange(len(self.xyz)), self.xyz)
        return self._made["index"]

    def sums(self, side: int | None = None) -> SumTree | None:
        """The places of a side, or of all, for sums; None without any."""
        if side not in self._made:
            own = slice(None) if side is None else self.side == side
            self._made[side] = SumTree(self.xyz[own], self.n[own]) if len(self.n[own]) else None
        return self._made[side]


def placed(df: DataFrame, of: str) -> DataFrame:
    """Rows with all coordinates, and finite ones. of: s or t."""
    return df.where(_FINITE.format(of))


def sites(t: DataFrame) -> DataFrame:
    """(target_id, tx, ty, tz, side if there, n): a row for each place, with its least id and number of rows."""
    return placed(t, "t").groupBy(*PLACE_T, *(c for c in t.columns if c == "side")).agg(F.min("target_id").alias("target_id"), F.count(F.lit(1)).alias("n"))


def held(t: DataFrame, copies: int = 1) -> Sites | None:
    """The sites of all rows, if rows are few."""
    there = placed(t, "t")
    if there.select("tx").limit(point_index.MOST + 1).count() > point_index.MOST:
        return None  # nothing of a large side comes to the driver
    got = there.limit(point_index.MOST + 1).toArrow()
    if not 0 < got.num_rows <= point_index.MOST or got.nbytes > point_index.MOST_BYTES:
        return None
    return Sites(got, copies)


def _answers(rows: pa.RecordBatch | pa.Table, names: tuple[str, ...], there: Sites, kernel: Kernel) -> tuple[np.ndarray, list]:
    """(row, columns) of what the kernel says of each row; rows that are alike in `names` are asked once."""
    q = np.stack([rows.column(c).to_numpy(zero_copy_only=False).astype(float) if isinstance(rows, pa.RecordBatch) else rows.column(c).to_numpy().astype(float) for c in names], 1)
    order = np.lexsort(q.T[::-1])
    first = np.concatenate([[True], (q[order][1:] != q[order][:-1]).any(1)])
    group = np.empty(len(q), np.int64)
    group[order] = np.cumsum(first) - 1
    who, columns = kernel(there, q[order][first])
    by = np.argsort(who, kind="stable")
    start, end = (np.searchsorted(who[by], group, side) for side in ("left", "right"))
    many = end - start
    at = by[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start, many)]
    return np.repeat(np.arange(len(q)), many), [c.take(pa.array(at)) if isinstance(c, pa.Array) else pa.array(c[at]) for c in columns]


def _tile(c: Column, side: float) -> Column:
    return F.floor(c / F.lit(side)).cast("long")


def _side(t: DataFrame, reach: float, least: int | None = None) -> tuple[float, bool]:
    """(the side of tiles: a multiple of reach, so that few rows are copied, with tiles enough and not too full on average; whether it is for targets that aren't copied: if there are `least` of them)."""
    cells = t.groupBy(_tile(F.col("tx"), reach), _tile(F.col("ty"), reach)).count()
    n, occupied = cells.agg(F.sum("count"), F.count(F.lit(1))).first()
    tiles, still = min(TILES, max(16, (n or 0) // 1000)), least is not None and (n or 0) >= least
    for m in (256, 128, 64, 32, 16, 8, 4, 2):
        if occupied >= tiles * m * m and n / occupied * (m if still else m + 2) ** 2 <= ROWS * (SUMMED if still else 1 / 4):
            return m * reach, still
    return reach, still


def _crowded(df: DataFrame, name: str, most: int) -> DataFrame:
    """(i, j, name): into how many parts tiles of more than `most` rows are dealt; at most a row for each `most` rows."""
    counts = df.groupBy("i", "j").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
    return counts.where(F.col(name) > 1)


def fold(s: DataFrame, t: DataFrame, reach: float, kernel: Kernel, out: str, query: tuple[str, ...] = PLACE_S, copies: int = 1, added: bool = False) -> tuple[DataFrame, bool]:
    """(rows of s with the columns `out` that the kernel finds for each from the targets up to reach around it, whether a source may have several answers to be put together).

    s: (source_id, sx, sy, sz, ...); t: (target_id, tx, ty, tz, and side, if there; and n, if rows are places already). The kernel is given sites that hold all those in reach, or a part of them, and distinct rows
    of the columns `query`; it names the rows that it found something for. copies: how many of the targets at one place it needs. Few targets, or few places, are sent to the sources; else both sides meet in
    tiles, targets copied to all tiles in reach. Tiles with more than ROWS rows are dealt over several groups. added: answers are sums, to be added up by source; then the sources are copied instead where they
    are less than half as many as the targets.
    """
    if not (reach > 0 and math.isfinite(reach)):
        raise ValueError("the reach must be positive and finite")
    found = StructType.fromDDL(out)
    fields, names = StructType([*s.schema.fields, *found.fields]), found.names
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
    nothing, s = [pa.array([], kinds[f.dataType.simpleString()]) for f in found], placed(s, "s")
    few = held(t, copies)
    if few is None and copies == 1 and "n" not in t.columns:
        t = staged(sites(t), "sites")
        few = held(t)
    if few is not None:
        sent = s.sparkSession.sparkContext.broadcast(few)

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if len(b):
                    row, columns = _answers(b, query, sent.value, kernel)
                    yield pa.RecordBatch.from_arrays([*b.take(pa.array(row)).columns, *columns], [*b.schema.names, *names])

        near = s.repartition(*PLACE_S).sortWithinPartitions(*PLACE_S)  # sources at one place are asked together
        return near.mapInArrow(ask, fields), False
    t = placed(t, "t") if copies == 1 else staged(placed(t, "t"), "targets")
    side, still = _side(t, reach, 2 * s.count() + 1 if added else None)
    pad, most = reach * 1.0001, ROWS * (SUMMED if added else 1)  # rounding must not lose one on the edge
    span = lambda c: F.explode(F.sequence(_tile(F.col(c) - pad, side), _tile(F.col(c) + pad, side)))
    at = lambda df, x, y: df.withColumns({"i": _tile(F.col(x), side), "j": _tile(F.col(y), side)})
    near = lambda df, x, y: df.withColumn("i", span(x)).withColumn("j", span(y))
    own, around = (near(s, "sx", "sy"), at(t, "tx", "ty")) if still else (at(s, "sx", "sy"), near(t, "tx", "ty"))
    parts, shares = staged(_crowded(around, "parts", most), "parts"), staged(_crowded(own, "shares", most), "shares")
    split = parts.limit(1).count() > 0
    many = lambda df: df.join(F.broadcast(parts), ["i", "j"], "left").join(F.broadcast(shares), ["i", "j"], "left").fillna(1, ["parts", "shares"])
    dealt = lambda ids, n: F.pmod(F.xxhash64(*ids), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    by = ["i", "j", "part", "share"]
    left = many(own).withColumn("share", dealt(("source_id", *PLACE_S), "shares")).withColumn("part", each("parts")).select(*s.columns, *by)
    # copies stay in one part, so the least ids of a place are all there
    right = many(around).withColumn("part", dealt(PLACE_T, "parts")).withColumn("share", each("shares")).select(*t.columns, *by)

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        row, columns = _answers(a, query, Sites(b, copies), kernel) if a.num_rows and b.num_rows else (np.zeros(0, np.int64), nothing)
        return pa.Table.from_arrays([*a.select(kept).take(pa.array(row)).columns, *columns], [*kept, *names])

    kept = s.columns
    if added:  # few bytes can be much work, so groups stay on as many tasks as there are
        n = int(s.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        left, right = left.repartition(n, *by), right.repartition(n, *by)
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, fields), split or still


def nearest_of(reach: float, k: int = 1, counted: bool = False) -> Kernel:
    """(target_id, d2, rank, tx, ty, tz) of the k nearest up to reach; ties to the least id. counted: and found, how many of the k there are."""

    def run(there: Sites, q: np.ndarray) -> tuple[np.ndarray, list]:
        query, rank, point, d2 = there.index.nearest(q[:, :3], k, reach)
        at = there.index.xyz[point]
        found = [np.bincount(query, minlength=len(q))[query].astype(np.int32)] if counted else []
        return query, [there.ids.take(pa.array(there.index.ids[point])), d2, rank.astype(np.int32), *at.T, *found]

    return run


MOMENT_SUMS = COLUMNS


def moments_of(reach: float, nearest: bool = True) -> Kernel:
    """MOMENT_SUMS of targets up to reach relative to the source; nearest: and the nearest one's target_id and d2."""

    def run(there: Sites, q: np.ndarray) -> tuple[np.ndarray, list]:
        total = there.sums().around(q[:, :3], Region(reach))
        if not nearest:
            found = np.flatnonzero(total[:, 0])
            return found, list(total[found].T)
        query, _, point, d2 = there.index.nearest(q[:, :3], 1, reach)
        return query, [*total[query].T, there.ids.take(pa.array(there.index.ids[point])), d2]

    return run


def counts_of(reach: float) -> Kernel:
    def run(there: Sites, q: np.ndarray) -> tuple[np.ndarray, list]:
        n = there.sums().around(q[:, :3], Region(reach), (0,))[:, 0]
        found = np.flatnonzero(n)
        return found, [n[found].astype(np.int64)]

    return run
