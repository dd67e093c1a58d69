"""Fast exact ids of a lower-casing word BPE tokenizer: a batch's distinct words are encoded once, and the latest are remembered.

The tokenizer splits at white space before anything else and its merges never cross words, so a text's ids are its
words' ids one after the other. Splitting, telling words apart, looking them up and putting ids together are Arrow's and
NumPy's work; only new words go to the tokenizer. Texts with characters for which that is not plain to see go to it whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters up to Latin Extended-B that no normal form and no splitting rule treats specially (no no-break space, no next-line).
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-ɏ]*")
#: Bytes that a worker process spends on the words it remembers, and bytes of the longest of them.
MEMORY, LONGEST = 24 << 20, 64
#: New words that are encoded in one go, and the control character between them, which no plain text holds.
BLOCK, MARK = 500, "\x01"


class WordTokens:
    def __init__(self, path: str, memory: int = MEMORY):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.normalizer = self.tokenizer.normalizer
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")
        (self.mark,) = self._ids(MARK)
        # what is remembered: words, how many ids each has, all ids, and the batch that last asked for a word
        self.memory, self.batch = memory, 0
        self.words = pa.array([], pa.string())
        self.count, self.ids, self.asked = np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _merged(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, their number for each word) of plain words, which need no other normal form than lower case."""
        cuts = np.append(np.arange(0, len(words), BLOCK), len(words)).astype(np.int32)
        blocks = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), words), f" {MARK} ")
        ids, count = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        self.tokenizer.normalizer = None
        try:
            for block in blocks:
                own = np.array(self._ids(block.as_py().lower() + f" {MARK}"), np.uint32)
                marks = np.flatnonzero(own == self.mark)
                ids.append(own[own != self.mark])
                count.append(np.diff(marks, prepend=-1) - 1)
        finally:
            self.tokenizer.normalizer = self.normalizer
        return np.concatenate(ids), np.concatenate(count)

    def _keep(self, words: pa.StringArray, ids: np.ndarray, count: np.ndarray) -> None:
        """Remembers words that aren't long. When memory is full, half of it stays: what was asked for last."""
        short = pc.binary_length(words).to_numpy() <= LONGEST
        self.words = pa.concat_arrays([self.words, words.filter(pa.array(short))])
        self.ids = np.concatenate([self.ids, ids[np.repeat(short, count)]])
        self.count = np.concatenate([self.count, count[short]])
        self.asked = np.concatenate([self.asked, np.full(int(short.sum()), self.batch)])
        size = pc.binary_length(self.words).to_numpy() + 4 * self.count + 20
        if size.sum() > self.memory:
            by = np.argsort(-self.asked, kind="stable")
            stay = np.zeros(len(by), bool)
            stay[by[: np.searchsorted(np.cumsum(size[by]), self.memory // 2)]] = True
            self.ids, self.words = self.ids[np.repeat(stay, self.count)], self.words.filter(pa.array(stay))
            self.count, self.asked = self.count[stay], self.asked[stay]

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        split = pc.utf8_split_whitespace(pa.array(texts, pa.string()))
        coded = split.values.dictionary_encode()
        words, which = coded.dictionary, coded.indices.to_numpy()
        self.batch += 1
        at = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy()
        there = at >= 0
        self.asked[at[there]] = self.batch
        new = words.filter(pa.array(~there))
        ids, own = self._merged(new)
        pool = np.concatenate([self.ids, ids])
        count, start = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        count[there], start[there] = self.count[at[there]], (np.cumsum(self.count) - self.count)[at[there]]
        count[~there], start[~there] = own, len(self.ids) + np.cumsum(own) - own
        self._keep(new, ids, own)
        each = count[which]
        end = np.cumsum(each)
        flat = pool[np.arange(end[-1] if len(end) else 0) + np.repeat(start[which] - (end - each), each)]
        cuts = np.append(0, end)[split.offsets.to_numpy()]
        return [flat[a:b].astype("<u4").tobytes() for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers, equal to the tokenizer's own without special tokens added."""
        plain = [bool(_PLAIN.fullmatch(t)) and not ("<|" in t and self.special.search(t)) for t in texts]
        done = iter(self._encode_plain([t for t, p in zip(texts, plain, strict=True) if p]))
        return [next(done) if p else np.array(self._ids(t), "<u4").tobytes() for t, p in zip(texts, plain, strict=True)]


_open: dict[str, WordTokens] = {}


def tokens_of(path: str) -> WordTokens:
    """The process's encoder of a file."""
    if path not in _open:
        _open[path] = WordTokens(path)
    return _open[path]
