"""Sharding by weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratamesh.llm._io import beside

#: Sub-shards in which slots are numbered: no task ever numbers a whole shard. A constant, so that slots depend on nothing but the rows.
SUBSHARD_DIGITS = 3


def _draw(key: Column, shard: int) -> Column:
    """60 pseudo-random bits of (key, shard) as 15 hex digits."""
    return F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 15)


def _bid(key: Column, shard: int, weight: float | None) -> Column:
    """What a shard bids for a key. Shards of one weight bid their draw; else weight / -ln(draw in (0, 1))."""
    if weight is None:
        return F.struct(_draw(key, shard).alias("bid"), F.lit(-shard).alias("neg"))
    unit = (F.conv(_draw(key, shard), 16, 10).cast("double") + 0.5) / float(1 << 60)
    return F.struct((F.lit(float(weight)) / -F.log(unit)).alias("bid"), F.lit(-shard).alias("neg"))


def rendezvous(df: DataFrame, key: str, shards: int, weights: Sequence[float] | None = None, out: str = "shard", grown: str | None = None) -> DataFrame:
    """Adds `out`, the shard that bids most for the row's key; `grown`, if named, is the same with one more shard of the last weight.

    A shard's bid depends on the key and that shard alone, so one more shard only takes rows into itself, and a
    changed weight moves only rows from or to that shard. Weights: positive, one a shard; none: all equal, without the arithmetic.
    A null key is a key of its own; equal keys share a shard; ties go to the smaller shard number.
    No shuffle. An existing column of the name `out` or `grown` is replaced; other columns stay.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    if weights is not None and (len(weights) != shards or min(weights) <= 0):
        raise ValueError("weights: one positive number for each shard")
    own = list(weights) if weights else [None] * shards

    def work(df: DataFrame) -> DataFrame:
        bids = [_bid(F.col("name"), i, w) for i, w in enumerate([*own, own[-1]])]
        df = df.withColumn("best", F.greatest(*bids[:-1]) if shards > 1 else bids[0])
        df = df.withColumn("shard", -F.col("best.neg"))
        return df.withColumn("grown", F.when(bids[-1]["bid"] > F.col("best.bid"), F.lit(shards)).otherwise(F.col("shard")))

    return beside(df, {"name": F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null"))}, work, {out: "shard"} | ({grown: "grown"} if grown else {}))


def with_slots(df: DataFrame, key: str, shard: str, order: Sequence[str], out: str = "slot") -> DataFrame:
    """Adds the row's place in its shard, gapless from 0, without bringing a shard together.

    Shards fall into 16**SUBSHARD_DIGITS sub-shards by a hash of the key and the `order` columns. Sub-shards are
    counted (one row each, whatever the input's size), and rows are numbered inside theirs from where it begins.
    `order` must tell rows apart up to full equality; shards must not be null; equal rows get neighbouring places in any order.
    The counted table has at most shards * 4096 rows, which bounds the broadcast. A column named `out` is replaced, all others stay.
    """
    keys = {f"o{i}": F.col(f"`{c}`") for i, c in enumerate(order)}

    def work(df: DataFrame) -> DataFrame:
        # where keys are null, the rest of the row spreads the rows
        spread = F.coalesce(F.col("name"), F.concat_ws("|", *(F.col(k).cast("string") for k in keys)))
        df = df.withColumn("sub", F.substring(F.md5(spread), 1, SUBSHARD_DIGITS))
        counts = df.groupBy("shard", "sub").agg(F.count(F.lit(1)).alias("n"))
        before = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.select(F.col("shard").alias("s"), F.col("sub").alias("b"), "n").select("s", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
        place = F.row_number().over(Window.partitionBy("shard", "sub").orderBy(*keys))
        placed = df.withColumn("place", place).join(F.broadcast(starts), (F.col("shard") == F.col("s")) & (F.col("sub") == F.col("b")))
        return placed.withColumn("slot", (F.col("start") + F.col("place") - 1).cast("long"))

    return beside(df, {"name": F.col(f"`{key}`").cast("string"), "shard": F.col(f"`{shard}`")} | keys, work, {out: "slot"})
