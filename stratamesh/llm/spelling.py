"""Spelling variants: words of a corpus that differ by one code point, and the commoner form each of them leads to.

The dictionary is sorted forwards and by its reversed words. One edit leaves a half of the shorter word intact, so two near
words share a prefix block of the one order or a suffix block of the other. Crowded blocks are subdivided by half of what
is left between the shared ends; blocks are scanned in sorted order and pairs verified.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamesh.llm._io import unstage, written

#: Words of at least so many code points, standing at least so often, enter the dictionary.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A form stands at least so many times as often as its variant.
FORM_TIMES = 2
#: Of the runs, those whose CRC-32 this divides lose a code point; 0: none do.
NOISE = 97
#: Words of a block over this are dealt to narrower blocks, until one code point is open.
CROWDED = 128
#: Words a task counts before it passes its counts on.
COUNTED = 300_000
#: Words of up to so many code points are compared as rows of a matrix, longer ones one by one.
MATRIX = 48

#: Latin-1 code points: letters a-z and from U+00C0 stay, A-Z become lower case, all others part words.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs(text: str | None, least: int = 1) -> Counter[bytes]:
    """The text's maximal runs of A-Z, a-z and U+00C0 to U+00FF of `least` code points or more, A-Z in lower case, as Latin-1."""
    got = Counter((text or "").encode("latin-1", "replace").translate(_LETTERS).split())
    return got if least < 2 else Counter({w: k for w, k in got.items() if len(w) >= least})


def misspelt(key: object, run: bytes, noise: int) -> bytes:
    """The run, one code point short where `noise` divides the CRC-32 of `<key>:<run>`."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), zlib.crc32(f"{'null' if key is None else key}:".encode()))
    return run if not noise or h % noise else run[: h % len(run)] + run[h % len(run) + 1 :]


def dictionary(docs: DataFrame, key: str = "doc_id", text: str = "text", noise: int = NOISE, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): every word of the texts that is long and common enough, with how often it stands. Null texts have no words; null keys count as `null`.

    Tasks pass on sums of what they have read, so a word of any frequency is a row a task and COUNTED words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def passed() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in total], pa.string())
            out = pa.RecordBatch.from_arrays([words, pa.array(total.values(), pa.int64())], ["word", "k"])
            total.clear()
            return out

        crc = zlib.crc32
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                begin = crc(f"{'null' if k is None else k}:".encode())
                for w, many in runs(t.as_py(), least_length).items():
                    if noise and not crc(w if w.isascii() else w.decode("latin-1").encode(), begin) % noise:
                        w = misspelt(k, w, noise)
                        if len(w) < least_length:
                            continue
                    total[w] += many
                if len(total) >= COUNTED:
                    yield passed()
        if total:
            yield passed()

    words = docs.select(F.col(key), F.col(text).alias("t")).mapInArrow(count, "word string, k long")
    return words.groupBy("word").agg(F.sum("k").alias("n")).where(F.col("n") >= least_count)


def one_edit(a: str, b: str) -> bool:
    """Whether the words differ by exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    low, high = 0, len(a)  # the common prefix ends between them
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return a[low + (len(a) == len(b)) :] == b[low + 1 :]


def near_rows(words: list[str], block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of near words of the same block; a block's words stand together, shorter ones first."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    short = length <= MATRIX
    chars = np.array([w if s else "" for w, s in zip(words, short, strict=True)], f"U{max(1, length[short].max(initial=1)) + 1}")
    chars = chars.view(np.uint32).reshape(len(words), -1)
    place = np.arange(chars.shape[1] - 1)
    left, right = [], []
    for d in range(1, len(words)):
        i = np.flatnonzero(block[d:] == block[:-d])
        if not len(i):
            break
        more = length[i + d] - length[i]
        for part in np.array_split(i[(more < 2) & short[i] & short[i + d]], max(1, len(i) // 8192)):
            a, b = chars[part], chars[part + d]
            differ = a != b
            replaced = differ.sum(1) == 1
            at = differ.argmax(1)
            inserted = ((a[:, :-1] == b[:, 1:]) | (place < at[:, None])).all(1)
            found = part[np.where(length[part + d] == length[part], replaced, inserted)]
            left.append(found)
            right.append(found + d)
        for k in i[~(short[i] & short[i + d])]:
            if one_edit(words[k], words[k + d]):
                left.append([k])
                right.append([k + d])
    none = [np.empty(0, np.int64)]
    return np.concatenate(none + left).astype(np.int64), np.concatenate(none + right).astype(np.int64)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, word, n) sorted by block, length and word -> (word, near, near_n) of near words, either way round."""

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        words, n = rows.column("word").to_pylist(), rows.column("n").to_numpy()
        block = rows.column("block").combine_chunks()
        new = pc.not_equal(block.slice(1), block.slice(0, max(0, len(block) - 1))).to_numpy(zero_copy_only=False)
        i, j = near_rows(words, np.concatenate([[0], np.cumsum(new)]))
        word = pa.array(words, pa.string())
        a, b = np.concatenate([i, j]), np.concatenate([j, i])
        return pa.RecordBatch.from_arrays([word.take(pa.array(a)), word.take(pa.array(b)), pa.array(n[b], pa.int64())], ["word", "near", "near_n"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        blocks = b.column(b.schema.get_field_index("block"))
        cut = pc.index(pc.equal(blocks, blocks[-1]), True).as_py()  # where the batch's last block begins, which may go on
        if cut or (held and held[-1].column("block")[-1] != blocks[0]):
            done = [*held, b.slice(0, cut)] if cut else held
            held = [b.slice(cut)]
            yield pairs(pa.Table.from_batches(done))
        else:
            held.append(b)
    if held:
        yield pairs(pa.Table.from_batches(held))


def near_words(words: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(word, near, near_n): every pair of words (word, n) that differ by exactly one code point, either way round.

    A block holds words of m code points and of m + 1 that share their first p and last s code points; half of the m - p - s
    between them is intact at one end or the other, so a crowded block's pairs are all found in its narrower blocks.
    In the end one code point of m is open, and the words of m share that place with no more words than an alphabet has letters.
    """
    length = F.length("word")
    m = F.explode(F.array(length, length - 1)).alias("m")
    rows = words.select("word", "n", m).where(F.col("m") >= LEAST_LENGTH - 1)
    half = F.floor(F.col("m") / 2).cast("int")
    ends = lambda p, s: F.struct(p.alias("p"), s.alias("s"))
    rows = rows.select("word", "n", "m", F.explode(F.array(ends(half, F.lit(0)), ends(F.lit(0), half))).alias("e")).select("word", "n", "m", "e.p", "e.s")
    # (left and right take a column's length; reverse() makes the suffix a prefix of the reversed dictionary)
    block = F.concat_ws(".", "m", "p", "s", F.expr("left(word, p)"), F.expr("left(reverse(word), s)")).alias("block")
    ready = []
    while True:
        rows = written(rows.select("word", "n", "m", "p", "s", block), "blocks")
        sizes = rows.groupBy("block").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.length("word") == F.col("m")).alias("short"), F.first(F.col("m") - F.col("p") - F.col("s")).alias("open"))
        full = written(sizes.where(f"k > {crowded} AND short > 0 AND open > 1").select(F.col("block").alias("b")), "crowded")
        if full.isEmpty():
            ready.append(rows)
            break
        ready.append(rows.join(full, F.col("block") == F.col("b"), "left_anti"))
        inside = rows.join(full, F.col("block") == F.col("b"))
        more = F.floor((F.col("m") - F.col("p") - F.col("s")) / 2).cast("int")
        rows = inside.select("word", "n", "m", F.explode(F.array(ends(F.col("p") + more, F.col("s")), ends(F.col("p"), F.col("s") + more))).alias("e")).select("word", "n", "m", "e.p", "e.s")
    all_ = ready[0]
    for r in ready[1:]:
        all_ = all_.unionByName(r)
    found = all_.select("block", "word", "n").repartitionByRange("block").sortWithinPartitions("block", F.length("word"), "word").mapInArrow(_scan, "word string, near string, near_n long")
    return found.repartition("word").dropDuplicates()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of pointers (word, form): where following forms ends. Forms are commoner than their words, so pointers make no circle; each round doubles the steps taken."""
    now = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        then = now.select(F.col("word").alias("w"), F.col("root").alias("r"))
        now, before = written(now.join(then, F.col("root") == F.col("w"), "left").select("word", F.coalesce("r", "root").alias("root"), F.col("r").isNotNull().alias("moved")), "forms"), now
        moved = not now.where("moved").isEmpty()
        unstage(before)
        if not moved:
            return now.select("word", "root")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", noise: int = NOISE, crowded: int = CROWDED) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every dictionary word.

    form: of the words one code point away the one that stands most often, the first in code-point order on ties, if it
    stands FORM_TIMES times as often as the word at least, else null. root: from the word over forms to the last one.
    Null and empty texts have no words; repeated rows count as often as they stand; a text may be a single word of any length. No
    other column of docs is looked at. An empty table gives an empty one.
    """
    words = written(dictionary(docs, key, text, noise), "dictionary")
    best = F.min(F.struct((-F.col("near_n")).alias("k"), F.col("near").alias("w")))
    near = near_words(words, crowded).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    formed = F.col("n_near").isNotNull() & (-F.col("best.k") >= FORM_TIMES * F.col("n"))
    judged = words.join(near, "word", "left").select(
        "word", F.when(formed, F.col("best.w")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, -F.col("best.k")).alias("form_n"))
    judged = written(judged, "judged")
    ends = roots(judged.where("form IS NOT NULL").select("word", "form"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
