"""Quality rules: a linear-chain conditional random field marks each line as content or boilerplate."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratamesh.llm._io import give_back

#: Labelled documents that the field is fitted on, at most (those with the smallest hashes of their ids).
MAX_FIT_DOCS = 600
#: Lines of all those documents that it is fitted on, at most.
MAX_FIT_LINES = 60_000
#: Places of lines that are worked on at once in training: some 200 bytes each.
BATCH = 40_000
SYMBOLS = "#*$%&|<>"
_UPPER, _SYMBOL, _DIGIT, _BARS, _LOUD = (bytes(s, "ascii") for s in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "#*$%&<>{}", "0123456789", "|", "!?"))
#: Upper bounds of the bins that a share falls into; a line has one active feature for each statistic.
_BINS = (0.0, 0.03, 0.1, 0.25, 0.5)
_STATS = ("upper", "symbol", "digit", "bars", "loud", "repeats", "seen", "length", "stop")
FEATURES = len(_STATS) * (len(_BINS) + 1)
BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class LineCrf:
    """emit[k]: how much feature k speaks for boilerplate; move[a][b]: for b after a (0 content, 1 boilerplate); start: for beginning as boilerplate."""

    emit: tuple[float, ...]
    move: tuple[tuple[float, float], tuple[float, float]]
    start: float = 0.0


def _bin(share: float) -> int:
    for i, b in enumerate(_BINS):
        if share <= b:
            return i
    return len(_BINS)


def line_features(line: bytes, words: list[bytes], seen: bool) -> list[int]:
    """The line's active features, one for each statistic; a line has a word at least."""
    n = len(line)
    k = len(words)
    shares = [(n - len(line.translate(None, c))) / n for c in (_UPPER, _SYMBOL, _DIGIT, _BARS, _LOUD)]
    shares.append(1 - len(set(words)) / k if k > 3 else 0.0)
    shares.append(1.0 if seen else 0.0)
    shares.append(0.0 if k < 3 else 0.05 if k < 8 else 0.2 if k < 30 else 1.0)
    shares.append(0.0 if line.rstrip()[-1:] in b".!?" else 1.0)
    return [i * (len(_BINS) + 1) + _bin(x) for i, x in enumerate(shares)]


def read_lines(text: str) -> tuple[list[tuple[int, list[int]]], int, list[bytes]]:
    """([(code points, features) of each line with a word], repeated lines, all words)."""
    seen: set[bytes] = set()
    lines, repeated, words = [], 0, []
    for line in text.encode().split(b"\n"):
        own = line.split()  # of bytes: at blank, tab, newline, return, \x0b, \x0c
        if own:
            again = line in seen
            repeated += again
            seen.add(line)
            words += own
            lines.append((len(line.decode()), line_features(line, own, again)))
    return lines, repeated, words


def viterbi(model: LineCrf, lines: list[list[int]]) -> list[int]:
    """The likeliest labels; ties go to content."""
    emit, move = model.emit, model.move
    a, b, back = 0.0, 0.0, []
    for i, feats in enumerate(lines):
        e = sum([emit[k] for k in feats])
        if i:
            fa, fb = b + move[1][0] > a + move[0][0], b + move[1][1] > a + move[0][1]
            a, b = (b + move[1][0] if fa else a + move[0][0]), (b + move[1][1] if fb else a + move[0][1]) + e
            back.append((fa, fb))
        else:
            b = e + model.start
    if not lines:
        return []
    out = [int(b > a)]
    for pair in reversed(back):
        out.append(int(pair[out[-1]]))
    return out[::-1]


def base_statistics(text: str, repeated: int, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """The columns of BASE_COLUMNS. A word counts as repeated if a 3-word window over it stands twice or more in the text."""
    n = len(words)
    blanks = sum(map(text.count, " \t\n\x0b\x0c\r"))
    windows = list(zip(words, words[1:], words[2:], strict=False))
    inside = 0
    if len(set(windows)) < len(windows):
        counts, last = Counter(windows), 0
        for i, w in enumerate(windows):
            if counts[w] > 1:
                inside += i + 3 - max(i, last)
                last = i + 3
    return n, len(text) - blanks, sum(map(text.count, SYMBOLS)), repeated, inside


def judge(model: LineCrf, text: str, min_words: int, repeat_percent: int, min_share: float) -> tuple:
    lines, repeated, words = read_lines(text)
    base = base_statistics(text, repeated, words)
    failed = base[0] < min_words or 100 * base[4] > repeat_percent * base[0]
    labels = viterbi(model, [f for _, f in lines])
    total = sum(n for n, _ in lines)
    share = sum(n for (n, _), y in zip(lines, labels, strict=True) if not y) / total if total else 0.0
    return (*base, failed, share, sum(labels), not failed and share >= min_share)


def mark(docs: DataFrame, model: LineCrf, text: str = "text", min_words: int = 50, repeat_percent: int = 50, min_share: float = 0.5) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, n_boilerplate_lines and kept.

    A document is kept unless it fails the base rules (fewer than min_words words, or more than repeat_percent
    percent of its words in 3-word windows that stand twice or more) or lines that Viterbi decoding calls content hold
    less than min_share of its lines' characters. Null and empty texts have zeros, fail and aren't kept; repeated rows
    are judged alike; columns of the added names are replaced, others stay. One pass over whole texts without a
    shuffle; a task holds one batch of rows.
    """
    names = [*BASE_COLUMNS, "base_failed", "content_share", "n_boilerplate_lines", "kept"]
    types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.int64(), pa.bool_()]
    kept = [c for c in docs.columns if c not in names]
    source = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)), F.col(f"`{text}`").alias("x"))
    spark_type = {"int64": T.LongType(), "bool": T.BooleanType(), "double": T.DoubleType()}
    schema = source.drop("x").schema
    for i, t in enumerate(types):
        schema = schema.add(f"r{i}", spark_type[str(t)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [judge(model, t or "", min_words, repeat_percent, min_share) for t in b.column("x").to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
            own = [(f, b.column(f.name)) for f in b.schema if f.name != "x"]
            fields = [f for f, _ in own] + [pa.field(f"r{i}", t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([c for _, c in own] + [pa.array(c, t) for c, t in zip(cols, types, strict=True)], schema=pa.schema(fields))
            del rows, cols
            give_back()

    out = source.mapInArrow(run, schema)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)), *(F.col(f"r{i}").alias(n) for i, n in enumerate(names)))


@dataclass
class Batch:
    """Sequences of about one length, the places after a shorter one's end left out by `there`."""

    feats: np.ndarray
    there: np.ndarray
    labels: np.ndarray
    counts: np.ndarray
    bad: np.ndarray


def batches_of(seqs: list[np.ndarray], labels: list[int], counts: list[float], places: int = BATCH) -> list[Batch]:
    """The sequences (lines x statistics) by length, in batches of at most `places` places, or of one sequence. Lines of bad documents start as boilerplate."""
    order = sorted(range(len(seqs)), key=lambda i: len(seqs[i]))
    out, own = [], []
    for k, i in enumerate(order):
        own.append(i)
        if k + 1 == len(order) or len(seqs[order[k + 1]]) * (len(own) + 1) > places:
            t = len(seqs[i])
            feats, there = np.full((len(own), t, len(_STATS)), FEATURES, np.uint8), np.zeros((len(own), t), bool)
            for r, j in enumerate(own):
                feats[r, : len(seqs[j])], there[r, : len(seqs[j])] = seqs[j], True
            bad = np.array([not labels[j] for j in own])
            out.append(Batch(feats, there, (there & bad[:, None]).astype(np.int8), np.array([counts[j] for j in own]), bad))
            own = []
    return out


def gradients(b: Batch, emit: np.ndarray, move: np.ndarray, start: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(negative log-likelihood, its derivatives by emit, move and start) of a batch's labels, sequences by their counts."""
    n, t, f = b.feats.shape
    there = b.there
    e = np.zeros((n, t, 2))
    for k in range(f):
        e[:, :, 1] += emit[b.feats[:, :, k]]
    e[:, :, 1] *= there
    e[:, 0, 1] += start
    alpha, beta = e.copy(), np.zeros((n, t, 2))
    for j in range(1, t):
        a = np.logaddexp(alpha[:, j - 1, :1] + move[0], alpha[:, j - 1, 1:] + move[1]) + e[:, j]
        alpha[:, j] = np.where(there[:, j, None], a, alpha[:, j - 1])
    for j in range(t - 2, -1, -1):
        nxt = e[:, j + 1] + beta[:, j + 1]
        back = np.stack([np.logaddexp(move[k, 0] + nxt[:, 0], move[k, 1] + nxt[:, 1]) for k in (0, 1)], 1)
        beta[:, j] = np.where(there[:, j + 1, None], back, 0)
    z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    p = np.exp(alpha + beta - z[:, None, None])[:, :, 1] * there
    off = (p - b.labels * there) * b.counts[:, None]
    ge = np.zeros_like(emit)
    for k in range(f):
        ge += np.bincount(b.feats[:, :, k].ravel(), off.ravel(), len(emit))
    ge[-1] = 0
    pair = there[:, 1:] & there[:, :-1]
    gm, path = np.zeros((2, 2)), (e[:, :, 1] * b.labels).sum(1)
    for x in (0, 1):
        for y in (0, 1):
            q = np.exp(alpha[:, :-1, x] + move[x, y] + e[:, 1:, y] + beta[:, 1:, y] - z[:, None]) * pair
            taken = (b.labels[:, :-1] == x) & (b.labels[:, 1:] == y) & pair
            path = path + move[x, y] * taken.sum(1)
            gm[x, y] = ((q - taken) * b.counts[:, None]).sum()
    return float(((z - path) * b.counts).sum()), ge, gm, np.array([off[:, 0].sum()])


def train(docs: list[tuple[str, int]], rounds: int = 3, steps: int = 60, max_lines: int = 400, bad_share: float | None = None, total_lines: int = MAX_FIT_LINES) -> LineCrf:
    """The field of (text, quality) pairs, where only documents are labelled.

    Lines of good documents are content. Lines of bad ones start as boilerplate and are then relabelled by the
    fitted field (hard expectation-maximisation), so clean lines inside a bad document become content again.
    Sequences over max_lines lines are trained on in pieces. If all documents have more than total_lines lines, each gives no more than its
    share of them, from its middle. Without both labels, everything is content. bad_share: how many
    documents are bad where the field is to be used, if the sample has another share; documents then count by how common their like are.
    """
    share = None
    if sum(text.count("\n") + 1 for text, _ in docs) > total_lines:
        share = max(1, total_lines // len(docs))
    own = sum(q == 0 for _, q in docs) / max(1, len(docs))
    seqs, labels, counts = [], [], []
    for text, quality in docs:
        if share is not None and (there := text.count("\n") + 1) > share:
            text = "\n".join(text.split("\n")[(there - share) // 2 :][:share])
        lines = np.array([f for _, f in read_lines(text)[0]], np.uint8).reshape(-1, len(_STATS))
        for i in range(0, len(lines), max_lines):
            seqs.append(lines[i : i + max_lines])
            labels.append(quality)
            counts.append(1.0 if bad_share is None or not 0 < own < 1 else bad_share / own if quality == 0 else (1 - bad_share) / (1 - own))
    if len(set(labels)) < 2:
        return LineCrf((-1.0 / len(_STATS),) * FEATURES, ((0.0, 0.0), (0.0, 0.0)))
    batches = batches_of(seqs, labels, counts)
    total = float(sum((b.there.sum(1) * b.counts).sum() for b in batches))
    emit, move, start = np.zeros(FEATURES + 1), np.zeros((2, 2)), np.zeros(1)
    for r in range(rounds):
        if r:
            model = LineCrf(tuple(emit[:-1]), tuple(map(tuple, move)), float(start[0]))
            for b in batches:
                for i in np.flatnonzero(b.bad):
                    got = viterbi(model, b.feats[i, b.there[i]].tolist())
                    if any(got):
                        b.labels[i, : len(got)] = got
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in (emit, move, start)]
        for step in range(1, steps + 1):
            sums = [np.zeros_like(w) for w in (emit, move, start)]
            for b in batches:
                for to, g in zip(sums, gradients(b, emit, move, start)[1:], strict=True):
                    to += g
            for w, g, (m, v) in zip((emit, move, start), sums, moments, strict=True):
                g = g / total + 1e-4 * w
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return LineCrf(tuple(map(float, emit[:-1])), tuple(tuple(map(float, x)) for x in move), float(start[0]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", max_docs: int = MAX_FIT_DOCS, max_chars: int = 20_000) -> LineCrf:
    """The field of at most max_docs labelled documents of at most max_chars characters (half of either label where there are enough), by smallest hashes of their keys. The driver gets those documents.

    The sample has as many of either label; in training, documents count by how common their label is among all labels.
    A key that stands more than once counts once, with the greatest of its texts and labels. Null texts are left out. Of the documents'
    lines, train() takes at most MAX_FIT_LINES, in batches, so the driver needs some tens of MB whatever texts look like.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("_key"), (F.col(label) > 0).cast("int").alias("_label")).distinct()
    halves = [known.where(F.col("_label") == y).orderBy(F.xxhash64("_key"), "_key").limit(max_docs // 2) for y in (0, 1)]
    chosen = halves[0].unionByName(halves[1]).groupBy("_key").agg(F.max("_label").alias("_label"))
    rows = docs.select(F.col(key).alias("_doc"), F.col(text).alias("_text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_key")).where(F.length("_text") <= max_chars)
    # one text a key before the driver gets any: a table may hold a labelled row any number of times
    rows = rows.groupBy("_key", "_label").agg(F.max("_text").alias("_text")).collect()
    got = {r["_key"]: r for r in sorted(rows, key=lambda r: r["_key"])}
    there = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    known_docs = sum(there.values())
    return train([(r["_text"], r["_label"]) for r in got.values()], bad_share=min(0.99, max(0.001, there.get(0, 0) / known_docs)) if known_docs else None)
