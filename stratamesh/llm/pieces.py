"""SentencePiece BPE encoding and decoding by suffix-array matching.

The distinct words of a batch are laid into one text. Its suffix array, sorted as deep as the longest piece, is searched
for every piece of the vocabulary at once; the ranges found are edges (from, to, piece) of a graph over the text's
places. Edges are sorted by where they end and relaxed in that order: of the edges into a place, exactly one
continues the merges' result of the prefix before it, and that one is kept. A very long word is indexed in parts and relaxed by itself.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Words remembered at most by each worker process, and characters that are indexed at once.
MAX_WORDS, MAX_CHARS = 600_000, 1_500_000
#: Characters from which a word is matched by itself, place by place, and characters of it that are indexed at once.
LONG, PART = 2_000, 200_000
_CUT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_BIG = np.int64(1) << 40


def merged(text: str, rank: dict[str, float]) -> list[str]:
    """Byte-pair merges in their order, leftmost first: what the other way is held against, and what odd words take."""
    sym, nxt, prv = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
    heap = [(rank[a + b], i, a + b) for i, (a, b) in enumerate(zip(sym, sym[1:], strict=False)) if a + b in rank]
    heapq.heapify(heap)
    n = len(sym)
    while heap:
        _, i, s = heapq.heappop(heap)
        j = nxt[i]
        if j >= n or not sym[i] or sym[i] + sym[j] != s:
            continue
        sym[i], sym[j], nxt[i] = s, "", nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
        for a, b in ((prv[i], i), (i, nxt[i])):
            if a >= 0 and b < n and (t := sym[a] + sym[b]) in rank:
                heapq.heappush(heap, (rank[t], a, t))
    return [s for s in sym if s]


class PieceMatcher:
    """A BPE model's pieces, ready to be matched. Models that rewrite texts before they cut them are refused."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        for probe in ("aAÄﬁ ①", "a  b"):
            if sp.normalize(probe) != SPACE + probe.replace(" ", SPACE):
                raise ValueError("only models with the identity normalizer, a prefix space and spaces kept are supported")
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.bytes = {int(names[i][1:-1], 16): i for i in range(len(names)) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        own = {names[i]: i for i in range(len(names)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        if any(SPACE in p.lstrip(SPACE) for p in own) or any(c not in own for p in own for c in p):
            raise ValueError("only vocabularies of words with all their characters are supported")
        self.ids, self.names = own, names
        self.byte_of = {v: k for k, v in self.bytes.items()}
        self.control = {i for i in range(len(names)) if sp.is_control(i)}
        # a byte of ASCII is a character by itself, whatever stands around it
        self.texts = [chr(self.byte_of[i]) if self.byte_of.get(i, 128) < 128 else n.replace(SPACE, " ") for i, n in enumerate(names)]
        #: Ids whose text can't be told by themselves.
        self.odd = np.array([self.byte_of.get(i, 0) > 127 or i in self.control or i == self.unknown for i in range(len(names))])
        self.rank = {p: -sp.get_score(i) for p, i in own.items() if len(p) > 1}
        # pieces in the order in which they come to be: characters, then merges; runs of spaces aside
        usual = [p for p in own if SPACE * 2 not in p]
        order = sorted((p for p in usual if len(p) == 1)) + sorted((p for p in usual if len(p) > 1), key=self.rank.__getitem__)
        at = {p: i for i, p in enumerate(order)}
        self.chars = len([p for p in usual if len(p) == 1])
        self.left, self.right = np.arange(len(order)), np.arange(len(order))
        whole = np.ones(len(order), bool)
        for i in range(self.chars, len(order)):
            # the merge that makes the piece: its parts are what the earlier merges leave of it
            parts = merged(order[i], _Below(self.rank, self.rank[order[i]]))
            whole[i] = len(parts) == 2
            if whole[i]:
                self.left[i], self.right[i] = at[parts[0]], at[parts[1]]
        made = np.flatnonzero(whole & (np.arange(len(order)) >= self.chars))
        keys = self.left[made] * np.int64(len(order)) + self.right[made]
        by = np.argsort(keys)
        self.pair_keys, self.pair_made = keys[by], made[by].astype(np.int64)
        self.order_ids = np.array([own[p] for p in order], np.int64)
        # matched pieces, as code points in rows
        self.match = np.flatnonzero(whole)
        self.lengths = np.array([len(order[i]) for i in self.match])
        self.depth = int(self.lengths.max())
        rows = np.zeros((len(self.match), 4 * -(-self.depth // 4)), np.uint64)
        for r, i in enumerate(self.match):
            rows[r, : len(order[i])] = [ord(c) for c in order[i]]
        self.alphabet = np.unique(rows[rows > 0])
        if len(self.alphabet) > 65_000:
            raise ValueError("vocabularies of more than 65,000 characters aren't supported")
        # four characters to a number, so that places compare by few numbers; masks blank what lies past a piece's end
        coded = np.where(rows > 0, np.searchsorted(self.alphabet, rows) + 2, 0).astype(np.uint64)
        shift = np.array([48, 32, 16, 0], np.uint64)
        self.quads = (coded.reshape(len(rows), -1, 4) << shift).sum(2, dtype=np.uint64)
        self.masks = ((coded > 0).astype(np.uint64).reshape(len(rows), -1, 4) * np.uint64(0xFFFF) << shift).sum(2, dtype=np.uint64)
        self.known: dict[str, bytes] = {}
        self.piece_length = [len(p) for p in order]
        self.scalar: tuple[dict[int, int], list[int], list[int]] | None = None

    def _made(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What two neighbours merge into, in making order; _BIG for nothing."""
        key = a * np.int64(len(self.order_ids)) + b
        i = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[i] == key, self.pair_made[i], _BIG)

    def adjacent(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges of piece a's and piece b's text together leave exactly a and b.

        Both are undone merge by merge, the later one first; they aren't left if at some point the ends that meet would have merged before what was undone.
        """
        out = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b, limit = a.copy(), b.copy(), np.full(len(a), _BIG)
        while len(live):
            clash = self._made(a, b) < limit
            out[live[clash]] = False
            later = a > b
            inner_a, inner_b = self.right[a], self.left[b]
            can_a, can_b = inner_a != a, inner_b != b
            undo_a = can_a & (later | ~can_b)
            undo_b = can_b & ~undo_a
            limit = np.where(undo_a, a, np.where(undo_b, b + 1, limit))
            a, b = np.where(undo_a, inner_a, a), np.where(undo_b, inner_b, b)
            go = ~clash & (undo_a | undo_b)
            live, a, b, limit = live[go], a[go], b[go], limit[go]
        return out

    def _suffixes(self, codes: np.ndarray) -> tuple[np.ndarray, int]:
        """(suffix array of codes, sorted by their first `depth` characters at least, that depth)."""
        rank, deep, n = codes.astype(np.int64), 1, len(codes)
        while True:
            after = np.zeros(n, np.int64)
            after[: max(0, n - deep)] = rank[deep:] + 1
            key = rank * np.int64(n + len(self.alphabet) + 3) + after
            order = np.argsort(key)
            deep *= 2
            if deep >= self.depth:
                return order, deep
            ordered = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))

    def _edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(from, to, piece) of every occurrence of every piece."""
        suffixes, _ = self._suffixes(codes)
        n = len(codes)
        padded = np.concatenate([codes, np.zeros(4 * -(-self.depth // 4) + 3, codes.dtype)]).astype(np.uint64)
        m = len(padded) - 3
        quads = padded[:m] << np.uint64(48) | padded[1 : m + 1] << np.uint64(32) | padded[2 : m + 2] << np.uint64(16) | padded[3 : m + 3]

        def search(past: bool) -> np.ndarray:
            lo, hi = np.zeros(len(self.quads), np.int64), np.full(len(self.quads), n)
            while (lo < hi).any():
                mid = np.minimum((lo + hi) // 2, n - 1)
                there = suffixes[mid]
                less, same = np.zeros(len(lo), bool), np.ones(len(lo), bool)
                for d in range(self.quads.shape[1]):
                    c, r = quads[there + 4 * d] & self.masks[:, d], self.quads[:, d]
                    less |= same & (c < r)
                    same &= c == r
                up = (less | same if past else less) & (lo < hi)
                lo, hi = np.where(up, mid + 1, lo), np.where(up | (lo >= hi), hi, mid)
            return lo

        first, last = search(False), search(True)
        count = last - first
        skip = np.repeat(first - (np.cumsum(count) - count), count)
        start = suffixes[np.arange(count.sum()) + skip]
        piece = np.repeat(self.match, count)
        return start, start + np.repeat(self.lengths, count), piece

    def _learn(self, words: list[str]) -> None:
        """Remembers the ids of words, none of which has a run of spaces."""
        sizes = np.array([len(w) + 1 for w in words])
        begin = np.cumsum(sizes) - sizes
        ends = begin + sizes - 1
        raw = "\0".join([*words, ""])
        codes = self._coded(raw)
        codes[ends] = 0
        word = np.repeat(np.arange(len(words)), sizes)
        start, end, piece = self._edges(codes)
        odd = np.flatnonzero(codes == 1)  # characters without a piece stand alone
        start, end, piece = np.concatenate([start, odd]), np.concatenate([end, odd + 1]), np.concatenate([piece, np.full(len(odd), -1)])
        step = end - begin[word[start]]
        by = np.argsort(step.astype(np.uint16) if step.max() < 1 << 16 else step, kind="stable")
        start, end, piece, step = start[by], end[by], piece[by], step[by]
        best = np.full(len(codes) + 1, -2)
        marks = np.flatnonzero(np.diff(step)) + 1
        for lo, hi in zip([0, *marks], [*marks, len(step)], strict=True):
            s, e, p = start[lo:hi], end[lo:hi], piece[lo:hi]
            before = best[s]
            free = (s == begin[word[s]]) | (p < 0) | (before == -1)
            check = np.flatnonzero(~free & (before >= 0))
            good = free & ((s == begin[word[s]]) | (before != -2))
            good[check] = self.adjacent(before[check], p[check])
            best[e[good]] = p[good]
        place, who, got, owner = ends.copy(), np.arange(len(words)), [], []
        length = np.ones(len(self.order_ids) + 1, np.int64)
        length[self.match] = self.lengths
        while len(who):
            p = best[place]
            got.append(p)
            owner.append(who)
            place = place - np.where(p < 0, 1, length[p])
            got[-1] = np.where(p < 0, -3 - place, self.order_ids[p])  # an odd character by its place
            more = place > begin[who]
            place, who = place[more], who[more]
        ids, owner = np.concatenate(got[::-1]), np.concatenate(owner[::-1])
        by = np.argsort(owner, kind="stable")
        ids, cuts = ids[by], np.cumsum(np.bincount(owner, minlength=len(words)))
        flat, lo = ids.astype("<u4").tobytes(), 0
        self.known.update((w, flat[4 * a : 4 * b]) for w, a, b in zip(words, [0, *cuts.tolist()], cuts.tolist(), strict=False))
        for i in set(owner[by][ids < 0].tolist()):
            own = ids[cuts[i - 1] if i else 0 : cuts[i]].tolist()
            self.known[words[i]] = _packed(chain.from_iterable(self._raw(raw[-3 - k]) if k < 0 else (k,) for k in own))

    def _coded(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.minimum(np.searchsorted(self.alphabet, raw), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == raw, at + 2, 1)

    def _fits(self, a: int, b: int) -> bool:
        """adjacent() of one pair."""
        (made, left, right), n, most = self.scalar, len(self.order_ids), int(_BIG)
        limit = most
        while made.get(a * n + b, most) >= limit:
            inner_a, inner_b = right[a], left[b]
            if inner_a != a and (a > b or inner_b == b):
                limit, a = a, inner_a
            elif inner_b != b:
                limit, b = b + 1, inner_b
            else:
                return True
        return False

    def _long(self, word: str) -> bytes:
        """The ids of one long word without a run of spaces: edges of one part after the other, relaxed place by place.

        Besides the word, a part's index and four bytes for each character are held.
        """
        if self.scalar is None:
            self.scalar = dict(zip(self.pair_keys.tolist(), self.pair_made.tolist(), strict=True)), self.left.tolist(), self.right.tolist()
        size, known = len(self.order_ids), {}
        best = array("i", [-2]) * (len(word) + 1)
        for lo in range(0, len(word), PART):
            codes = np.append(self._coded(word[lo : lo + PART + self.depth]), 0)
            start, end, piece = self._edges(codes)
            odd = np.flatnonzero(codes == 1)
            start, end, piece = np.concatenate([start, odd]), np.concatenate([end, odd + 1]), np.concatenate([piece, np.full(len(odd), -1)])
            own = np.flatnonzero(start < PART)
            own = own[np.argsort(end[own], kind="stable")]
            for s, e, p in zip((start[own] + lo).tolist(), (end[own] + lo).tolist(), piece[own].tolist(), strict=True):
                before = best[s]
                if s == 0 or (before != -2 and (p < 0 or before == -1)):
                    best[e] = p
                elif before >= 0:
                    key = before * size + p
                    good = known.get(key)
                    if good is None:
                        if len(known) > MAX_WORDS:
                            known.clear()
                        good = known[key] = self._fits(before, p)
                    if good:
                        best[e] = p
        ids, place, length = array("I"), len(word), self.piece_length
        while place > 0:
            p = best[place]
            if p < 0:
                place -= 1
                ids.extend(self._raw(word[place])[::-1])
            else:
                place -= length[p]
                ids.append(int(self.order_ids[p]))
        return np.array(ids, "<u4")[::-1].tobytes()

    def _raw(self, char: str) -> list[int]:
        if not self.bytes:
            return [self.unknown]
        return [self.bytes[b] for b in char.encode()]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers, equal to the model's own."""
        cut = [_CUT.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        # the batch's own words in a small map: few far looks into the large ones, however often a word stands
        distinct = list(set().union(*cut))
        own = dict(zip(distinct, map(self.known.get, distinct), strict=True))
        new = [w for w, ids in own.items() if ids is None]
        if len(self.known) + len(new) > MAX_WORDS:
            self.known = {k: v for k, v in own.items() if v is not None}
        plain, chars = [], 0
        own.update((w, self._long(w)) for w in new if len(w) > LONG and SPACE * 2 not in w)
        new = [w for w in new if own[w] is None]
        for w in new:
            if SPACE * 2 in w or "\0" in w:
                self.known[w] = _packed(chain.from_iterable((self.ids[s],) if s in self.ids else self._raw(s) for s in merged(w, self.rank)))
                continue
            plain.append(w)
            chars += len(w) + 1
            if chars >= MAX_CHARS:
                self._learn(plain)
                plain, chars = [], 0
        if plain:
            self._learn(plain)
        own.update((w, self.known[w]) for w in new)
        get = own.__getitem__
        return [b"".join(map(get, words)) for words in cut]

    def decode(self, ids: Sequence[int] | bytes) -> str:
        """The text: runs of byte pieces as UTF-8, spaces for their marks, without the prefix space. Control ids have no text; ids out of range raise IndexError."""
        own = np.frombuffer(ids, "<u4") if isinstance(ids, bytes) else np.asarray(ids, np.int64)
        if len(own) and not 0 <= own.min() <= own.max() < len(self.names):
            raise IndexError("an id out of the vocabulary")
        if not self.odd[own].any():
            whole = "".join(map(self.texts.__getitem__, own.tolist()))
            return whole[1:] if whole[:1] == " " else whole
        out, run = [], bytearray()
        for i in [*own.tolist(), -1]:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode(errors="replace"))
                run = bytearray()
            if i >= 0 and i not in self.control:
                out.append(" ⁇ " if i == self.unknown else self.texts[i])
        whole = "".join(out)
        return whole[1:] if whole[:1] == " " else whole


def _packed(ids: Iterable[int]) -> bytes:
    return np.fromiter(ids, "<u4").tobytes()


class _Below(dict):
    """Ranks under a bound."""

    def __init__(self, rank: dict[str, float], bound: float):
        self.rank, self.bound = rank, bound

    def __contains__(self, s: object) -> bool:
        return self.rank.get(s, self.bound) < self.bound

    def __getitem__(self, s: str) -> float:
        return self.rank[s]


_open: dict[str, PieceMatcher] = {}


def matcher_of(path: str) -> PieceMatcher:
    """The process's matcher of a model file."""
    if path not in _open:
        _open[path] = PieceMatcher(path)
    return _open[path]


def _by_chars(texts: pa.Array, most: int) -> Iterator[tuple[int, list[str]]]:
    lo, held, chars = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t.as_py() or "")
        chars += len(held[-1])
        if chars >= most:
            yield lo, held
            lo, held, chars = i + 1, [], 0
    if held:
        yield lo, held


def encoded(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", batch_chars: int = 6_000_000) -> DataFrame:
    """(key, ids) of every row: the whole text's ids. Null and empty texts have none; repeated rows have equal ones. No shuffle; other columns aren't looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher_of(model)
        for b in batches:
            for lo, held in _by_chars(b.column(1), batch_chars):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(held)), pa.array([np.frombuffer(x, "<i4") for x in m.encode(held)], pa.list_(pa.int32()))], ["k", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def decoded(rows: DataFrame, model: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """Adds `out`, the ids' text; null ids give null. A column of that name is replaced. No shuffle."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = matcher_of(model)
        for b in batches:
            yield pa.array([None if x is None else m.decode(x) for x in b.to_pylist()], pa.string())

    return rows.withColumn(out, F.arrow_udf(run, "string")(F.col(ids)))


def digests(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", batch_chars: int = 6_000_000) -> DataFrame:
    """(key, n_ids, ids_crc32, round_trip) of every row, in one pass: the ids' count and CRC-32 (little-endian unsigned 32-bit), and whether decoding them gives the text again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher_of(model)
        for b in batches:
            for lo, held in _by_chars(b.column(1), batch_chars):
                ids = m.encode(held)
                same = [m.decode(x) == t for x, t in zip(ids, held, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, len(held)), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(crc32, ids), pa.int64()), pa.array(same)], ["k", "n_ids", "ids_crc32", "round_trip"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, n_ids long, ids_crc32 long, round_trip boolean").withColumnRenamed("k", key)
