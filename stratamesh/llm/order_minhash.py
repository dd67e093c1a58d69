"""Document fingerprints by Order MinHash.

Of a text's k-mers, each numbered by how often it stood before, every one of m hash functions selects the l least;
those are put back into text order and hashed as a tuple. Two texts agree in a tuple only if they share the k-mers and
their order, so the share of agreeing tuples falls with edit distance, and not only with what the texts hold.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamesh.llm._io import parts

#: Characters of a k-mer, k-mers of a tuple, tuples of a fingerprint.
WIDTH, TUPLE, TUPLES = 8, 2, 128
#: Bits for repeats, and for the places of texts that have fewer k-mers, below a k-mer's hash.
_AT = 24
#: Ranges of ids for each shuffle partition: enough for partitions to come out even.
RANGES = 8

_RNG = np.random.default_rng(20_240_607)
_A = _RNG.integers(1, 1 << 31, TUPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, TUPLES, dtype=np.uint32)
_BASE = int(_RNG.integers(1, 1 << 62)) * 2 + 1
#: The base to the powers 1, 2, 4, ...
_P = [np.uint64(pow(_BASE, 1 << i, 1 << 64)) for i in range(8)]
_MAX = np.uint32(np.iinfo(np.uint32).max)
#: K-mers that are looked at together by all hash functions.
_BLOCK = 8192


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(29))


def _kmers(codes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every `width` code points; the whole text if it has fewer."""
    h = codes.astype(np.uint64) + np.uint64(1)
    width = min(width, len(codes))
    done, size, power = h, 1, 0
    while size * 2 <= width:  # base**size joins two neighbours of `size` characters
        done = done[:-size] * _P[power] + done[size:]
        size, power = size * 2, power + 1
    for i in range(size, width):
        done = done[:-1] * _P[0] + h[i:]
    return _mixed(done)


_LOW = np.uint64((1 << _AT) - 1)


def _sorted(h: np.ndarray, packed: bool) -> tuple[np.ndarray, np.ndarray]:
    """(k-mers, places) by k-mer, then place. packed: both fit into one number, which is faster to sort."""
    if packed:
        tagged = np.sort((h & ~_LOW) | np.arange(len(h), dtype=np.uint64))
        return tagged & ~_LOW, tagged & _LOW
    at = np.argsort(h & ~_LOW, kind="stable")
    return h[at] & ~_LOW, at.astype(np.uint64)


def _numbered(kmer: np.ndarray) -> np.ndarray:
    """A hash of every one of the sorted k-mers and its number among its equals, from 0 in text order."""
    n = len(kmer)
    new = np.flatnonzero(np.concatenate([[True], kmer[1:] != kmer[:-1]]))
    if len(new) == n:
        return _mixed(kmer)
    again = (np.arange(n) - np.repeat(new, np.diff(np.append(new, n)))).astype(np.uint64)
    item, high = _mixed(kmer | (again & _LOW)), again >> np.uint64(_AT)
    return np.where(high > 0, _mixed(item + high * _P[0]), item) if high.any() else item


def sketch(text: str, width: int = WIDTH) -> np.ndarray:
    """TUPLES hashes of 16 bits. The empty text has zeros, a text of fewer than `width` characters counts as one k-mer.

    Texts of any length: k-mers are told apart by the same 40 bits in all of them, so long and short texts can be compared.
    """
    if not text:
        return np.zeros(TUPLES, np.uint16)
    h = _kmers(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), width)
    n = len(h)
    kmer, at = _sorted(h, n < 1 << _AT)
    item = _numbered(kmer)
    take = min(TUPLE, n)
    short = (item >> np.uint64(32)).astype(np.uint32)  # orders are drawn from 32 bits, which is twice as fast
    rows = np.arange(TUPLES)
    best = np.full((TUPLES, take), _MAX)
    where = np.full((TUPLES, take), -1)
    for lo in range(0, n, _BLOCK):
        x = np.multiply.outer(_A, short[lo : lo + _BLOCK])
        x += _B[:, None]
        for _ in range(min(take, x.shape[1])):  # the least of what is left goes through the best so far
            k = x.argmin(1)
            v, w = x[rows, k], k + lo
            x[rows, k] = _MAX
            for i in range(take):
                swap = (v < best[:, i]) | (where[:, i] < 0)
                v, best[swap, i] = np.where(swap, best[:, i], v), v[swap]
                w, where[swap, i] = np.where(swap, where[:, i], w), w[swap]
    order = np.argsort(at[where], axis=1, kind="stable")
    picked = np.take_along_axis(item[where], order, 1)
    out = np.full(TUPLES, n if n < TUPLE else TUPLE, np.uint64)
    for i in range(take):
        out = _mixed((out ^ picked[:, i]) * np.uint64(0x9E3779B97F4A7C15) + rows.astype(np.uint64))
    return (out >> np.uint64(48)).astype(np.uint16) | np.uint16(1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """How alike one k-mer of a tuple is: a tuple agrees if all of its TUPLE k-mers do, so that root of the share of equal tuples."""
    return float((a == b).mean() ** (1 / TUPLE))


def fingerprint(x: np.ndarray) -> str:
    return x.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The text with its last floor(n / 4) characters replaced by the first as many (or all) of the following one."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint", width: int = WIDTH) -> DataFrame:
    """Adds `out`, the fingerprint of the row's whole text as hex. Null counts as empty; equal texts have equal ones. No shuffle."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([fingerprint(sketch(t.as_py() or "", width)) for t in texts], pa.string())

    return docs.withColumn(out, F.arrow_udf(run, "string")(F.col(text)))


def _ranges(docs: DataFrame, key: str, n: int) -> list[int]:
    """At most n keys that begin a range of rows each, of about equal counts; each is a key of docs, the first the least."""
    keys = docs.where(F.col(key).isNotNull())
    marks = keys.agg(F.percentile_approx(key, [i / n for i in range(n)], max(10_000, 10 * n)).alias("p"), F.min(key).alias("m")).first()
    return sorted({marks["m"], *(marks["p"] or [])}) if marks["m"] is not None else []


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row and its next by ascending key.

    After the last row comes the first; one row alone is its own next. Null keys come first, equal keys by text, null
    texts count as empty; repeated rows are rows of their own. Other columns aren't looked at.

    Rows go to ranges of keys once; the first row of each range also goes to the end of the range before, so every row
    meets its next in one task without a sort of all rows. Only the bounds of ranges come to the driver: RANGES for each
    shuffle partition. A task holds two texts and a batch of rows; rows are sorted by Spark, which spills.
    """
    spark = docs.sparkSession
    n = parts(spark)
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    bounds = _ranges(rows, "k", RANGES * n)
    lowest = -(1 << 63)
    least = rows.where("k IS NULL").limit(1).count() > 0
    if least:
        bounds = [lowest, *bounds]
    index = spark.sparkContext.broadcast(bounds)
    last = len(bounds) - 1

    def place(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = index.value
        for ids in batches:
            yield pa.array([max(0, bisect.bisect_right(own, lowest if k is None else k) - 1) for k in ids.to_pylist()], pa.int32())

    ranged = rows.withColumn("r", F.arrow_udf(place, "int")(F.col("k")))
    starts = F.coalesce(F.col("k"), F.lit(lowest))
    # the first row of a range, again, for the range before; of rows with one key the reader takes the first
    firsts = ranged.where(starts.isin(bounds) if len(bounds) <= 64 else _is_bound(starts, index))
    firsts = firsts.groupBy("r").agg(F.min(F.struct(F.coalesce("k", F.lit(lowest)).alias("o"), "t")).alias("m"))
    copies = firsts.select(F.lit(None).cast("long").alias("k"), F.col("m.t").alias("t"), F.when(F.col("r") == 0, last).otherwise(F.col("r") - 1).alias("r"), F.lit(1).alias("copy"))
    both = ranged.withColumn("copy", F.lit(0)).unionByName(copies)
    dealt = both.repartition(n, "r").sortWithinPartitions("r", "copy", F.col("k").asc_nulls_first(), "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            done: list[list] = [[] for _ in range(7)]
            for k, t, r, copy in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                t = t.as_py()
                x = sketch(t, width)
                if held is not None and held[2] == r:
                    hk, ht, _, hx = held
                    new = edited(ht, t)
                    e = sketch(new, width)
                    for col, v in zip(done, (hk, len(ht), hashlib.sha256(new.encode()).hexdigest(), fingerprint(hx), fingerprint(e), likeness(hx, e), likeness(hx, x)), strict=True):
                        col.append(v)
                held = None if copy else (k, t, r, x)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(done, KINDS, strict=True)], NAMES)

    out = dealt.mapInArrow(run, "k long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("k", key)


def _is_bound(keys, index):
    def test(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = set(index.value)
        for ids in batches:
            yield pa.array([k in own for k in ids.to_pylist()], pa.bool_())

    return F.arrow_udf(test, "boolean")(keys)


KINDS = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
NAMES = ["k", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
