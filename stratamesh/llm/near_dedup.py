"""Near-duplicate detection by b-bit MinHash.

Band keys of MinHash signatures give candidates; the low bits of the minima, packed into bit planes, give each
candidate a collision-corrected similarity; those that pass are confirmed on the documents' full shingle sets.

No group is ever turned into all of its pairs. Documents with equal shingle sets become one node. In every band
bucket all nodes are compared with two hubs, the least id and the smallest set; what that links becomes one component, which settles large groups of
copies. What stays open are buckets whose nodes lie in several components: small ones are compared node by
node across components, large ones by their rarest shingles (a prefix filter, which loses no pair of the wanted similarity).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamesh.llm._io import give_back, written
from stratamesh.llm.components import components

BANDS, ROWS, BITS = 32, 4, 4
#: Minima of a signature; the first BANDS * ROWS of them make the bands.
MINIMA = 256
#: 64-bit words of a bit plane.
PLANE = MINIMA // 64
#: Candidates whose estimate is lower than the wanted similarity by more than this aren't confirmed: five standard deviations of the estimate at 0.75.
SLACK = 0.145
#: Bits of the filter that keeps texts nobody asks for from being shingled again. Its size is fixed; when it fills up it only filters less.
FILTER_BITS = 1 << 24
#: Buckets in which (nodes outside the largest component) * nodes is over this are compared by their rarest shingles.
SMALL_BUCKET = 64 * 64

#: Shingles whose counts tell the order of large buckets' shingles; a longer list would only order them better.
FREQUENT = 65_536

_RNG = np.random.default_rng(20_240_501)
_A = _RNG.integers(1, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, MINIMA, dtype=np.uint64)
_MIX = _RNG.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD_MIX = [np.uint64(int(x) | 1) for x in _RNG.integers(1, 1 << 63, 5, dtype=np.uint64)]


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The text's distinct shingles as sorted 64-bit hashes. Fewer words than `width` are one shingle; no words, none."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, and only blank, \t, \n, \x0b, \x0c and \r split
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    if n < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    out = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        out = (out + h[i : n - width + 1 + i]) * _WORD_MIX[i % 5]
        out ^= out >> np.uint64(29)
    return np.unique(mixed(out))


def minima(h: np.ndarray) -> np.ndarray:
    """The least image of the hashes under each of the fixed permutations."""
    out = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 1024):
        x = np.multiply.outer(h[i : i + 1024], _A)
        x += _B
        np.minimum(out, x.min(0), out=out)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    return mixed((mixed(m[: BANDS * ROWS]).reshape(BANDS, ROWS) * _MIX).sum(1, dtype=np.uint64)).view(np.int64)


def packed(m: np.ndarray) -> np.ndarray:
    """BITS low bits of every minimum as bit planes: plane by plane, PLANE words each."""
    low = (mixed(m) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    planes = [np.packbits(low >> b & 1, bitorder="little") for b in range(BITS)]
    return np.concatenate(planes).view(np.int64)


def estimate(a: Column, b: Column) -> Column:
    """Similarity of two packed signatures: the share of equal minima, less what BITS bits agree by chance."""
    equal = F.lit(0)
    for w in range(PLANE):
        differ = F.lit(0).cast("long")
        for p in range(BITS):
            differ = differ.bitwiseOR(a[p * PLANE + w].bitwiseXOR(b[p * PLANE + w]))
        equal = equal + (F.lit(64) - F.bit_count(differ))
    chance = 2.0**-BITS
    return (equal / F.lit(float(MINIMA)) - chance) / (1 - chance)


def signatures(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(id, n, digest, bands, sig) of every row: shingle count, digest of the shingle set, band keys, packed signature; the last two are null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digests, bands, sigs = [], [], [], []
            for t in b.column(1):
                h = shingles(t.as_py(), width)
                n.append(len(h))
                digests.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                m = minima(h) if len(h) else None
                bands.append(band_keys(m) if len(h) else None)
                sigs.append(packed(m) if len(h) else None)
            arrays = [b.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n", "digest", "bands", "sig"])
            del arrays, n, digests, bands, sigs
            give_back()

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).mapInArrow(run, "id long, n long, digest binary, bands array<long>, sig array<long>")


def _asked(ids: DataFrame) -> np.ndarray:
    """The bit filter of a column id: FILTER_BITS bits, whatever the number of ids."""
    bit = F.pmod("id", F.lit(FILTER_BITS))
    words = ids.groupBy((bit / 64).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("id", F.lit(64)).cast("int"))).alias("v")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words.column("w").to_numpy()] = words.column("v").to_numpy()
    return out


def shingle_sets(docs: DataFrame, ids: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(id, set) of the rows whose key the filter of ids lets through: all that stand in ids, and few others."""
    bits = docs.sparkSession.sparkContext.broadcast(_asked(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(0).to_numpy(zero_copy_only=False) % FILTER_BITS
            hit = np.flatnonzero(bits.value[at >> 6] >> (at & 63) & 1)
            for part in np.array_split(hit, max(1, len(hit) // 500)):
                own = b.take(pa.array(part))
                sets = [shingles(t.as_py(), width).view(np.int64) for t in own.column(1)]
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "set"])
            give_back()

    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    return rows.mapInArrow(run, "id long, set array<long>")


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text: str, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough: first by packed signatures, then on the sets. A pair may stand more than once."""
    sig = lambda x: nodes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}"))
    near = pairs.join(sig("a"), "a").join(sig("b"), "b")
    near = near.where(F.least("na", "nb") >= similarity * F.greatest("na", "nb")).where(estimate(F.col("sa"), F.col("sb")) >= similarity - SLACK)
    # (no distinct() on top of these joins: as rows lie by b, it would need no exchange of its own, and a hub could not be split)
    near = written(near.select("a", "b"), "near")
    asked = near.select(F.col("a").alias("id")).unionByName(near.select(F.col("b").alias("id")))
    sets = written(shingle_sets(docs, asked, key, text, width), "sets")
    both = near.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    percent = round(similarity * 100)
    return both.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")


def _across(rows: DataFrame, by: str, staged: bool = False) -> tuple[DataFrame, DataFrame]:
    """(open, largest): rows (by, id, comp) of the groups that hold several components, with n and least: members, and members outside the largest component. staged: groups are written before rows meet them."""
    sizes = rows.groupBy(by, "comp").agg(F.count(F.lit(1)).alias("k"))
    groups = sizes.groupBy(by).agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("comps"), F.max(F.struct("k", "comp")).alias("top")).where("comps > 1")
    groups = groups.select(by, "n", (F.col("n") - F.col("top.k")).alias("least"), F.col("top.comp").alias("main"))
    if staged:
        groups = written(groups, "groups")
    return rows.join(groups, by), groups


def _with_partner(rows: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(id, comp) of bucket members that have a member of another component with a signature alike enough; looking ends at the first."""
    own = written(rows.select("band", "id", "comp", "k").join(nodes.select("id", "sig"), "id"), "large")
    other = own.select(F.col("band").alias("b2"), F.col("comp").alias("c2"), F.col("k").alias("k2"), F.col("sig").alias("s2"))
    sizes = F.least("k", "k2") >= F.lit(similarity) * F.greatest("k", "k2")
    alike = estimate(F.col("sig"), F.col("s2")) >= similarity - SLACK
    return own.join(other, (F.col("band") == F.col("b2")) & (F.col("comp") != F.col("c2")) & sizes & alike, "left_semi").select("id", "comp").distinct()


def _pairs(rows: DataFrame, by: str, nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs of a group's members in different components whose signatures are alike enough; of two in the largest component, none is looked at.

    Rows have the set's size k and `behind`: how much of the set, in the order that all sets share, doesn't stand before
    the shared shingle. Sets that first meet there have at most the smaller `behind` in common, which must be
    similarity / (1 + similarity) of both sizes together; pairs short of that are never made.
    """
    rows = rows.join(nodes.select("id", "sig"), "id")
    few = rows.where("comp <> main").select(by, F.col("id").alias("a"), F.col("comp").alias("ca"), F.col("main").alias("ma"), F.col("k").alias("ka"), F.col("behind").alias("ra"), F.col("sig").alias("sa"))
    all_ = rows.select(by, F.col("id").alias("b"), F.col("comp").alias("cb"), F.col("k").alias("kb"), F.col("behind").alias("rb"), F.col("sig").alias("sb"))
    enough = F.least("ra", "rb") * (1 + similarity) >= F.lit(similarity) * (F.col("ka") + F.col("kb")) - 1e-6
    alike = estimate(F.col("sa"), F.col("sb")) >= similarity - SLACK
    met = few.join(all_, by).where("ca <> cb").where("a < b OR cb = ma").where(enough).where(alike)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.75) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row.

    Documents are linked if their sets of distinct `width`-word shingles (A-Z in lower case) have a Jaccard
    similarity of `similarity` or more; component_id is the least key reachable over links, kept marks that row.
    Texts without words, null texts and rows with a null key are linked with nothing; for a null key component_id is
    null and kept true. Rows with equal keys are one document: what is linked with one is linked with all, and all of them
    are kept or none. Ties cannot occur: keys are integers. Other columns of docs aren't looked at.

    A pair of exactly 0.75 shares no band with probability 5e-6, of 0.8 with 5e-8, and fails the estimate with less.
    """
    table = written(signatures(docs, key, text, width), "signatures")
    full = table.where("n > 0 AND id IS NOT NULL")
    # nodes: one for each shingle set, named by the least key
    # (written, so that crowded digests meet them in a join whose sides adaptive execution can split)
    least = written(full.groupBy("digest").agg(F.min("id").alias("rep")), "least")
    mapped = written(full.select("id", "digest").join(least, "digest").select("id", "rep").distinct(), "nodes-of")
    first = least.select(F.col("digest").alias("d"), F.col("rep"))
    nodes = written(full.join(first, (F.col("id") == F.col("rep")) & (F.col("digest") == F.col("d"))).select("id", "digest", "n", "bands", "sig").dropDuplicates(["id", "digest"]).drop("digest"), "nodes")
    banded = nodes.select("id", "n", F.explode("bands").alias("band"))

    # a key whose rows have several sets ties their nodes
    multiple = mapped.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("id")
    own = mapped.join(multiple, "id").select(F.col("id").alias("a"), F.col("rep").alias("b"))

    # every bucket against two hubs: the least id, which many buckets have in common, and the smallest set, of texts around a shared passage the one that adds least
    hubs = banded.groupBy("band").agg(F.min("id").alias("h1"), F.min_by("id", "n").alias("h2"), F.count(F.lit(1)).alias("size")).where("size > 1")
    met = banded.join(hubs, "band").select("id", F.explode(F.array_distinct(F.array("h1", "h2"))).alias("hub")).where("id <> hub")
    star = met.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    links = written(confirmed(star, nodes, docs, key, text, width, similarity).unionByName(own), "links")
    comp = components(links)

    # buckets that still hold several components
    labelled = nodes.join(comp.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("comp"), F.col("n").alias("k"), "bands")
    left, _ = _across(labelled.select("id", "comp", "k", F.col("k").alias("behind"), F.explode("bands").alias("band")), "band")
    left = written(left, "open")
    small = _pairs(left.where(F.col("least") * F.col("n") <= SMALL_BUCKET), "band", nodes, similarity)
    large = written(_with_partner(left.where(F.col("least") * F.col("n") > SMALL_BUCKET), nodes, similarity), "large")
    pairs = small
    if large.limit(1).count():
        pairs = pairs.unionByName(_by_rare_shingles(large, nodes, docs, key, text, width, similarity)).distinct()
    more = confirmed(written(pairs.join(star, ["a", "b"], "left_anti"), "pairs"), nodes, docs, key, text, width, similarity)
    more = written(more, "more")
    if more.limit(1).count():
        comp = components(links.select("a", "b").unionByName(more))

    of = mapped.join(comp.withColumnRenamed("node", "rep"), "rep", "left").groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("c"))
    out = table.select("id", "n").join(of.withColumnRenamed("id", "i"), F.col("id") == F.col("i"), "left")
    whole = F.coalesce("c", "id")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), whole.alias("component_id"), F.coalesce(whole == F.col("id"), F.lit(True)).alias("kept"))


def _by_rare_shingles(members: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text: str, width: int, similarity: float) -> DataFrame:
    """Pairs of members (id, comp) in different components that share one of their rarest shingles.

    Of a set of k shingles, in one order for all, the first k - ceil(similarity * k) + 1 must meet those of any set it is
    similar enough to, and where two sets meet first tells how much they can share. That holds for any order; this one
    puts the FREQUENT shingles that stand most often last, so that few sets meet by what everybody has.
    """
    held = shingle_sets(docs, members.select("id"), key, text, width).join(members, "id").select("id", "comp", "set")
    held = written(held, "held")

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, c = np.unique(b.column(0).flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(v[c > 1]), pa.array(c[c > 1])], ["s", "c"])

    often = held.select("set").mapInArrow(repeated, "s long, c long").groupBy("s").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "s").limit(FREQUENT).toArrow()
    shingle, count = (often.column(c).to_numpy() for c in ("s", "c"))
    by = np.argsort(shingle)
    table = docs.sparkSession.sparkContext.broadcast((shingle[by], count[by]))

    def fronts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = table.value
        for b in batches:
            sizes, behind, found = [], [], []
            for own in b.column(2):
                x = own.values.to_numpy()
                k = len(x)
                at = np.minimum(np.searchsorted(known, x), max(0, len(known) - 1))
                c = np.where(known[at] == x, counts[at], 0) if len(known) else np.zeros(k, np.int64)
                p = k - math.ceil(k * similarity - 1e-9) + 1
                found.append(x[np.lexsort((x, c))][:p])
                sizes.append(k)
                behind.append(k - np.arange(p))
            n = np.array([len(x) for x in found])
            of = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), pa.array(np.repeat(sizes, n).astype(np.int64)), pa.array(np.concatenate(behind).astype(np.int64)), pa.array(np.concatenate(found))], ["id", "comp", "k", "behind", "s"])

    # written, so that both sides of the next join are plain exchanges, whose crowded keys adaptive execution can split
    front = written(held.mapInArrow(fronts, "id long, comp long, k long, behind long, s long"), "fronts")
    rows, _ = _across(front, "s", staged=True)
    return _pairs(written(rows, "rare"), "s", nodes, similarity)
