"""Near-duplicates by SimHash and multi-index hashing.

Fingerprints of 64 bits are cut into two segments. Of two fingerprints that differ in at most two bits, either the
first segments differ in one bit at most, or the second ones are equal. So a table by first segments is asked for each segment and
those one bit away, a table by second segments for each segment itself, and matches are verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamesh.llm._io import written
from stratamesh.llm.components import components

#: Words of a shingle, seed of its hash.
WIDTH, SEED = 3, 42
#: Fingerprints of a segment's bucket over this meet by the balls of whole fingerprints instead.
CROWDED = 64
_BITS = np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The text's SimHash as a signed 64-bit integer: a bit is 1 if it is in more than half of the shingles' hashes; 0 without words."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, and only blank, \t, \n, \x0b, \x0c and \r split
    n = len(words)
    if not n:
        return 0
    whole, k = b" ".join(words), max(1, n - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate([[0], ends[: k - 1]]).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, k, 8192):
        h = np.array([digest(whole[a:b], SEED) for a, b in zip(starts[i : i + 8192], (ends[-k:] - 1)[i : i + 8192].tolist(), strict=True)], np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.bitwise_or.reduce((2 * ones > k).astype(np.uint64) << _BITS).view(np.int64))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, fp) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t.as_py(), width) for t in b.column(1)], pa.int64())], ["id", "fp"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).mapInArrow(run, "id long, fp long")


def links(nodes: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(a, b): ties between nodes (fp, rep) of distinct fingerprints, that connect all whose fingerprints differ in one or two bits.

    In buckets of at most `crowded` fingerprints every match is verified. Fingerprints that would meet a larger bucket are sent
    to themselves and to each place one bit away: two that differ in two bits at most, and only such, have a place in
    common, where at most 65 meet and are tied to the least. So candidates are at most crowded times the probes, whatever lies close together.
    """
    nodes = nodes.select("fp", "rep", F.shiftrightunsigned("fp", 32).alias("first"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("second"))
    # the ball of one bit around the first segment; of two segments one bit apart only the one without that bit asks, so a pair meets once
    ball = F.expr("array_distinct(transform(sequence(-1, 31), i -> IF(i < 0, first, first | shiftleft(1L, i))))")
    asks = nodes.select(F.col("fp").alias("fa"), F.col("rep").alias("a"), F.col("first").alias("own"), F.explode(ball).alias("probe"))
    asks2 = nodes.select(F.col("fp").alias("fa"), F.col("rep").alias("a"), F.col("second").alias("probe2"))
    full = {s: written(nodes.groupBy(s).count().where(f"count > {crowded}").select(s), "crowded") for s in ("first", "second")}
    there = {s: nodes.join(full[s], s, "left_anti").select(F.col("fp").alias("fb"), F.col("rep").alias("b"), s) for s in full}
    apart = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb")))
    met = asks.join(there["first"], (F.col("probe") == F.col("first")) & apart.between(1, 2) & ((F.col("own") != F.col("first")) | (F.col("fa") < F.col("fb"))))
    met2 = asks2.join(there["second"], (F.col("probe2") == F.col("second")) & (apart == 2) & (F.col("fa") < F.col("fb")))
    near = met.select("a", "b").unionByName(met2.select("a", "b"))
    if all(x.isEmpty() for x in full.values()):
        return near
    shy = asks.join(full["first"], F.col("probe") == F.col("first"), "left_semi").select("fa", "a").unionByName(asks2.join(full["second"], F.col("probe2") == F.col("second"), "left_semi").select("fa", "a")).distinct()
    places = shy.select("a", F.explode(F.expr("transform(sequence(-1, 63), i -> IF(i < 0, fa, fa ^ shiftleft(1L, i)))")).alias("place"))
    stars = places.groupBy("place").agg(F.collect_list("a").alias("all")).where(F.size("all") > 1)
    return near.unionByName(stars.select(F.explode("all").alias("a"), F.array_min("all").alias("b")).where("a <> b").distinct())


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, crowded: int = CROWDED) -> DataFrame:
    """(key, fingerprint, component_id) of every row.

    Rows are linked if their fingerprints differ in at most two bits; component_id is the least key reachable over links. Null and
    empty texts have fingerprint zero and are linked like any other. Rows with a null key have a fingerprint, but link nothing, and their
    component_id is null. Rows with equal keys are one document. Equal fingerprints are one node, so copies make no pairs.
    Other columns of docs aren't looked at; an empty table gives an empty one.
    """
    table = written(fingerprints(docs, key, text, width), "fingerprints")
    known = table.where("id IS NOT NULL")
    nodes = written(known.groupBy("fp").agg(F.min("id").alias("rep")), "nodes")
    # a key whose rows have several fingerprints ties their nodes
    several = known.groupBy("id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y").select("id")
    own = known.join(several, "id", "left_semi").distinct().join(nodes, "fp").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    comp = components(written(links(nodes, crowded).unionByName(own), "links"))
    # (written: crowded fingerprints meet it in a join whose sides adaptive execution can split)
    of = written(nodes.join(comp, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("f"), F.coalesce("component", "rep").alias("c")), "component-of")
    out = table.join(of, F.col("fp") == F.col("f"), "left")
    return out.select(F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("id").isNotNull(), F.col("c")).alias("component_id"))
