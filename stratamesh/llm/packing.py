"""Best-fit packing of token pieces into sequences, with vectors of capacities.

Pieces of one length are alike, so the plan is made on the histogram of lengths: decreasing best fit over groups of
alike bins. A group is an interval of bin numbers with one residual vector (tokens, documents, attention cost); a step places a
piece of one length into each of the first c bins of a group. There are never more groups than lengths plus
one, so the driver's work depends on the length limit, not on the number of pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratamesh.llm._io import give_back, written
from stratamesh.llm.word_tokens import tokens_of

#: Sub-groups in which pieces of one length are numbered, so that no task numbers all pieces of a common length; a length with more pieces than SUBS * PER_SUB has more.
SUBS, PER_SUB = 64, 1_000_000
#: Bits below a length in the key of a placed piece.
_SHIFT = 44


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds. documents: pieces; attention: the sum of squared lengths (None: as many as fit)."""

    tokens: int = 4096
    documents: int | None = None
    attention: int | None = None


@dataclass(frozen=True)
class Plan:
    """Step i places `count` pieces of a length, from the key's rank on, into bins bin, bin + 1, ... at offset. Sorted by key = length << 44 | rank."""

    key: np.ndarray
    bin: np.ndarray
    offset: np.ndarray
    bins: int


def plan_bins(counts: dict[int, int], capacity: Capacity, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.01, 0.1)) -> Plan:
    """Vector best fit of counts[length] pieces for every length, longest first.

    Of the groups where a piece fits under every constraint, rule `norm` takes the one whose weighted residual after
    placing is least, `dot` the one whose residual has the largest weighted dot product with the piece. Ties go to
    the group made first. Every length must fit into an empty bin.
    """
    if rule not in ("norm", "dot"):
        raise ValueError("rule: norm or dot")
    full = np.array([capacity.tokens, capacity.documents or capacity.tokens, capacity.attention or capacity.tokens**2], float)
    w = np.asarray(weights) / full**2
    size = 1024
    residual, first, number = np.full((size, 3), -1.0), np.zeros(size, np.int64), np.zeros(size, np.int64)
    live, bins, steps = 0, 0, []
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        need = np.array([length, 1, length * length], float)
        if (need > full).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacity of an empty sequence")
        while left > 0:
            after = residual[:live] - need
            fits = (after >= 0).all(1)
            if fits.any():
                cost = (w * after**2).sum(1) if rule == "norm" else -(w * residual[:live] * need).sum(1)
                g = int(np.where(fits, cost, np.inf).argmin())
                start, there, rest = int(first[g]), int(number[g]), residual[g].copy()
            else:
                rest, g, start = full.copy(), -1, bins
                each = int((full // need).min())
                there = -(-left // each) if each > 1 else left
                bins += there
            c = min(left, there)
            steps.append((length << _SHIFT | rank, start, capacity.tokens - int(rest[0])))
            left, rank = left - c, rank + c
            if live + 2 > size:
                size *= 2
                residual, first, number = np.vstack([residual, np.full_like(residual, -1.0)]), np.concatenate([first, first * 0]), np.concatenate([number, number * 0])
            if g < 0 or c < there:
                if g >= 0:
                    first[g] += c
                    number[g] -= c
                elif c < there:
                    residual[live], first[live], number[live] = full, start + c, there - c
                    live += 1
                g, live = live, live + 1
            residual[g], first[g], number[g] = rest - need, start, c
            if residual[g].min() <= 0:  # nothing fits any more: the last group takes its place
                live -= 1
                residual[g], first[g], number[g] = residual[live], first[live], number[live]
    steps.sort()
    key, at, offset = (np.array(x, np.int64) for x in zip(*steps, strict=True)) if steps else (np.zeros(0, np.int64),) * 3
    return Plan(key, at, offset, bins)


def token_pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = 4096, end_id: int | None = 1, batch_chars: int = 2_000_000) -> DataFrame:
    """(key, piece, start, length, ids_crc32) of every document cut into pieces of `limit` ids; only the last is shorter.

    ids: the tokenizer's without special tokens, then end_id. Null texts count as empty. A document without ids has no
    piece. Whole texts are encoded, a bounded number of characters (but one text at least) at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = tokens_of(tokenizer), b"" if end_id is None else int(end_id).to_bytes(4, "little")
        for b in batches:
            keys, texts = b.column(0), b.column(1)
            lo, n, chars, held = 0, len(b), 0, []
            for i in range(n):
                held.append(texts[i].as_py() or "")
                chars += len(held[-1])
                if chars >= batch_chars or i == n - 1:
                    at, piece, start, length, crc = [], [], [], [], []
                    for j, raw in enumerate(encoder.encode(held)):
                        raw += last
                        for k, s in enumerate(range(0, len(raw) // 4, limit)):
                            own = raw[4 * s : 4 * (s + limit)]
                            at.append(lo + j)
                            piece.append(k)
                            start.append(s)
                            length.append(len(own) // 4)
                            crc.append(crc32(own))
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["k", "piece", "start", "length", "ids_crc32"])
                    lo, chars, held = i + 1, 0, []
            give_back()

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, piece int, start long, length long, ids_crc32 long")
    return out.withColumnRenamed("k", key)


def pack(pieces: DataFrame, key: str = "doc_id", capacity: Capacity = Capacity(), rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.01, 0.1)) -> DataFrame:
    """Adds sequence_id and offset to pieces (key, piece, start, length, ids_crc32, ...).

    Pieces of a sequence lie one after the other from offset 0 without gaps and keep every capacity. Pieces of no tokens
    or of a null length raise ValueError, as do those no empty sequence can hold. Repeated rows are pieces of their own. Columns named
    sequence_id and offset are replaced, all others stay, whatever their names.
    Pieces are numbered inside (length, hash) sub-groups, so no task holds all of a common length; the driver gets counts
    by length and sub-group: at most capacity.tokens * SUBS rows, and one more for PER_SUB pieces of the table.
    """
    spark: SparkSession = pieces.sparkSession
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    at = {c: f"c{i}" for i, c in enumerate(names)}  # inside, columns go by their places
    order = [at[key], at["piece"], at["ids_crc32"]]
    rows = written(pieces, "pieces").select(*(F.col(f"`{c}`").alias(a) for c, a in at.items()))
    rows = rows.withColumn("size", F.col(at["length"]))
    counts = rows.groupBy("size").agg(F.count(F.lit(1)).alias("n")).toArrow()
    length, n = (counts.column(c).to_numpy() for c in ("size", "n"))
    if len(length) and (not np.issubdtype(length.dtype, np.integer) or length.min() <= 0):
        raise ValueError("pieces must have a length of one token at least")
    if len(length) and length.max() > capacity.tokens:
        raise ValueError(f"a piece of {length.max()} tokens exceeds the capacity of an empty sequence")
    subs = np.full(capacity.tokens + 1, SUBS, np.int64)
    subs[length] = np.maximum(SUBS, -(-n // PER_SUB))
    into = F.lit(SUBS)
    for k in length[subs[length] > SUBS]:
        into = F.when(F.col("size") == int(k), int(subs[k])).otherwise(into)
    rows = rows.withColumn("sub", F.pmod(F.xxhash64(*order), into).cast("int"))
    plan = plan_bins(dict(zip(length.tolist(), n.tolist(), strict=True)), capacity, rule, weights)
    seen = rows.groupBy("size", "sub").agg(F.count(F.lit(1)).alias("n")).toArrow()
    base = subs.cumsum() - subs  # where a length's sub-groups begin
    table = np.zeros(int(subs.sum()), np.int64)
    table[base[seen.column("size").to_numpy()] + seen.column("sub").to_numpy()] = seen.column("n").to_numpy()
    before = np.append(0, table.cumsum())
    ranks = before[:-1] - np.repeat(before[base], subs)  # where each sub-group begins among the pieces of its length
    held = spark.sparkContext.broadcast((base, ranks, plan.key, plan.bin, plan.offset))
    place = F.row_number().over(Window.partitionBy("size", "sub").orderBy(*order)) - 1
    numbered = rows.withColumn("rank", place.cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, ranks, keys, bins, offsets = held.value
        own = list(at.values())
        for b in batches:
            length, sub, rank = (b.column(c).to_numpy() for c in ("size", "sub", "rank"))
            k = length << _SHIFT | (rank + ranks[base[length] + sub])
            step = np.searchsorted(keys, k, "right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), pa.array(bins[step] + k - keys[step]), pa.array(offsets[step])], [*own, "bin", "at"])

    out = numbered.mapInArrow(run, rows.select(*at.values()).schema.add("bin", "long").add("at", "long"))
    return out.select(*(F.col(a).alias(c) for c, a in at.items()), F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
