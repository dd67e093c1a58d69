"""A prefix trie over conversations: what their first turns have in common.

Paths are hash-partitioned by the digest of their first turn; a group of first turns becomes one pointer dictionary trie inside
applyInPandas. First turns of very many different conversations are dealt out again by their second turn, and so on; the nodes above
such a cut are put together from what lies below.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamesh.llm._io import WORD, parts, text_of, written

#: Distinct paths below a node over this are dealt out again by the next turn.
OVERSIZED = 200
#: Turns that a group of subtries holds on average.
GROUP_TURNS = 50_000
#: Ids that are put together before they are hashed.
IDS = 20_000
#: Turns at the start of a rebuilt conversation may come from the first one of its block of so many ids; their number is below SHARED_TURNS.
BLOCK, SHARED_TURNS = 20, 4
NO_IDS = hashlib.sha256(b"").hexdigest()


def turn_paths(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, path): every conversation's turns in order as an array of (d, w): a digest of role and text, and the text's words.

    Null roles and texts are empty. Null turns come first, turns of one number in the order of their digests; repeated rows are turns of their
    own. Rows without a conversation are let go. A conversation is one row of digests, not of texts.
    """
    said = F.concat(F.length(text_of(role)).cast("string"), F.lit(":"), text_of(role), text_of(text))
    rows = turns.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("c"), F.col(turn).alias("t"), F.md5(said).alias("d"), F.regexp_count(text_of(text), F.lit(WORD)).alias("w"))
    return rows.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("t", "d", "w"))).alias("p")).select("c", F.transform("p", lambda x: F.struct(x["d"].alias("d"), x["w"].alias("w"))).alias("path"))


def rebuilt(paths: DataFrame) -> DataFrame:
    """Paths (c, path) whose first h turns are those of conversation c - c % BLOCK (none if it isn't there), h being CRC-32 of c modulo SHARED_TURNS."""
    first = paths.where(F.col("c") % BLOCK == 0).select(F.col("c").alias("b"), F.slice("path", 1, SHARED_TURNS - 1).alias("head"))
    h = (F.crc32(F.col("c").cast("string")) % SHARED_TURNS).cast("int")
    met = paths.withColumn("h", h).join(first, F.col("c") - F.col("c") % BLOCK == F.col("b"), "left")
    head = F.when(F.col("head").isNull(), F.slice("path", 1, 0)).otherwise(F.slice("head", F.lit(1), F.col("h")))
    return met.select("c", F.concat(head, F.slice("path", F.col("h") + 1, F.greatest(F.size("path"), F.lit(1)))).alias("path"))


def _ends(rows: DataFrame) -> DataFrame:
    """(at, n, least, ends_sha256) of rows (c, at): how many ids end at a place, the least, and the hash of all, ascending.

    A hash reads its ids one after the other; what grows with a crowded place is that reading alone. Ranges of (place, id) write
    their ids as text first, and the place's task streams those texts.
    """

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids = None, []
        out: list[tuple] = []
        for b in batches:
            for place, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if ids and (place != at or len(ids) >= IDS):
                    out.append((at, ids[0], len(ids), ",".join(map(str, ids))))
                    ids = []
                at = place
                ids.append(c)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["at", "least", "n", "ids"])
                out = []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (at, ids[0], len(ids), ",".join(map(str, ids)))], ["at", "least", "n", "ids"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, least, n, sha = None, None, 0, None
        for b in batches:
            out = []
            for place, first, many, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if place != at:
                    if sha:
                        out.append((at, n, least, sha.hexdigest()))
                    at, least, n, sha = place, first, 0, hashlib.sha256()
                sha.update((("," if n else "") + ids).encode())
                n += many
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["at", "n", "least", "ends_sha256"])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (at, n, least, sha.hexdigest())], ["at", "n", "least", "ends_sha256"])

    chunks = rows.select("at", "c").repartitionByRange("at", "c").sortWithinPartitions("at", "c").mapInArrow(texts, "at string, least long, n long, ids string")
    return chunks.repartition("at").sortWithinPartitions("at", "least").mapInArrow(hashes, "at string, n long, least long, ends_sha256 string")


NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, stem string"


def subtries(pdf: pd.DataFrame) -> pd.DataFrame:
    """The nodes of the tries under one or more tops, of distinct paths (key, stem, up, depth, d, w, n, least, sha).

    key names a top, which stands at `depth` and below the node of `stem`, whose least member is `up`; d and w are a path's digests and words from
    the top on. Nodes are places in lists, and one dictionary points from (node, digest) to the child.
    """
    child: dict[tuple[int, str], int] = {}
    above, depth, words, members, least, ends, stem, up = [], [], [], [], [], [], [], []
    for key, s, u, top, digests, counts, n, c, sha in pdf.itertuples(index=False):
        at = -1
        for k, (d, w) in enumerate(zip(digests, counts, strict=True)):
            pointer = (at, d if k else key)
            nxt = child.get(pointer)
            if nxt is None:
                nxt = child[pointer] = len(above)
                above.append(at)
                depth.append(top + k)
                words.append(int(w))
                members.append(0)
                least.append(c)
                ends.append(NO_IDS)
                stem.append(None if k else s)
                up.append(None if k else u)
            members[nxt] += n
            least[nxt] = min(least[nxt], c)
            at = nxt
        ends[at] = sha
    total = len(above)
    children, leaves = [0] * total, [0] * total
    saved = [(m - 1) * w for m, w in zip(members, words, strict=True)]
    # postorder without recursion: a child is made after its parent, so from the last to the first every child comes before its parent
    for i in range(total - 1, -1, -1):
        leaves[i] = leaves[i] or 1
        if (p := above[i]) >= 0:
            children[p] += 1
            leaves[p] += leaves[i]
            saved[p] += saved[i]
    parent = pd.array([up[i] if p < 0 else least[p] for i, p in enumerate(above)], "Int64")
    return pd.DataFrame({"conv_id": least, "depth": depth, "parent_conv_id": parent, "n_convs": members, "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends, "stem": stem})


def _summed(below: DataFrame) -> DataFrame:
    """(s, n_children, leaves, saved) of the nodes right below each stem."""
    return below.where("stem IS NOT NULL").groupBy(F.col("stem").alias("s")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))


def trie(paths: DataFrame, oversized: int = OVERSIZED, group_turns: int = GROUP_TURNS) -> DataFrame:
    """Every node of the trie over paths (c, path), one row a conversation: its least member, depth, parent's least member, members, children,
    childless nodes and saved tokens of its subtree, and the hash of the ids that end there.

    The root has depth 0 and stands for all conversations; without any there is no node. Conversations of equal paths are one path with a count, however many. Only distinct paths
    are dealt out, and only a node with more than `oversized` of them is cut, so that a task holds about `group_turns` turns, or one longer conversation.
    """
    spark = paths.sparkSession
    place = lambda p: F.md5(F.array_join(F.transform(p, lambda x: x["d"]), ""))
    rows = written(paths.select("c", "path", place(F.col("path")).alias("at")), "paths")
    ends = written(_ends(rows), "ends")
    # one row a distinct path: that of its least conversation
    distinct = rows.select("c", "path").join(ends.select("n", "least", F.col("ends_sha256").alias("sha")), F.col("c") == F.col("least")).drop("c")
    total = ends.agg(F.sum("n").alias("n"), F.min("least").alias("least")).first()
    turn = lambda k: F.element_at("path", F.lit(k))
    rest = distinct.where(F.size("path") > 0).select("path", "n", "least", "sha", F.md5(turn(1)["d"]).alias("key"), F.lit("").alias("stem"), F.lit(total["least"]).cast("long").alias("up"))
    tops, stems, k = [], [], 1
    while True:
        rest = written(rest, "subtries")
        big = rest.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"), F.min("up").alias("parent_conv_id"), F.min("stem").alias("stem"), F.min(turn(k)["w"]).alias("words")).where(f"m > {oversized}").withColumnRenamed("key", "s")
        big = written(big, "stems")
        cut = not big.isEmpty()
        own = rest.join(big.select("s"), F.col("key") == F.col("s"), "left_anti") if cut else rest
        tail = F.slice("path", F.lit(k), F.size("path"))
        tops.append(own.select("key", "stem", "up", F.lit(k).alias("depth"), F.transform(tail, lambda x: x["d"]).alias("d"), F.transform(tail, lambda x: x["w"]).alias("w"), "n", "least", "sha"))
        if not cut:
            break
        inside = rest.drop("stem", "up").join(big.select("s", "conv_id"), F.col("key") == F.col("s"))
        stopped = inside.where(F.size("path") == k).select(F.col("s").alias("e"), "sha")
        stems.append(big.join(stopped, F.col("s") == F.col("e"), "left").drop("e", "m"))
        rest = inside.where(F.size("path") > k).select("path", "n", "least", "sha", F.md5(F.concat("key", turn(k + 1)["d"])).alias("key"), F.col("s").alias("stem"), F.col("conv_id").alias("up"))
        k += 1
    dealt = tops[0]
    for t in tops[1:]:
        dealt = dealt.unionByName(t)
    turns = rows.agg(F.sum(F.size("path"))).first()[0] or 0
    groups = max(parts(spark), -(-turns // group_turns))
    grouped = dealt.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(groups))).groupBy("bucket")
    nodes = written(grouped.applyInPandas(lambda pdf: subtries(pdf.drop(columns="bucket")), NODE), "nodes")
    for k in range(len(stems), 0, -1):
        kids = _summed(nodes.where(F.col("depth") == k + 1))
        made = stems[k - 1].join(kids.withColumnRenamed("s", "of"), F.col("s") == F.col("of")).select(
            "conv_id", F.lit(k).cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
            (F.col("saved") + (F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"), F.coalesce("sha", F.lit(NO_IDS)).alias("ends_sha256"), "stem")
        nodes = nodes.unionByName(written(made, "stem-nodes"))
    root_end = ends.where(F.col("at") == hashlib.md5(b"").hexdigest()).select("ends_sha256")
    top = nodes.where("depth = 1").agg(F.count(F.lit(1)).alias("n_children"), F.greatest(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    sha = (root_end.first() or [NO_IDS])[0]
    root = top.select(F.lit(total["least"]).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(total["n"] or 0).cast("long").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.lit(sha).alias("ends_sha256"))
    return nodes.drop("stem").unionByName(root.where("n_convs > 0"))


def prefix_trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", oversized: int = OVERSIZED) -> DataFrame:
    """trie() of the rebuilt conversations of turns. See turn_paths() for nulls, ties and repeated rows. An empty table gives no node; other columns aren't looked at."""
    return trie(written(rebuilt(turn_paths(turns, conv, turn, role, text)), "rebuilt"), oversized)
