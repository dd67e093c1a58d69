"""Secret scans: fixed patterns, and Markov models of random strings against ordinary identifiers.

Everything on the way from texts to spans is a column expression: no Python runs on executors.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamesh.llm._io import beside, text_of

#: Fixed values: (kind, pattern over the whole text, group and least length its match must have).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
#: A run is one match of `x+`, so asking for its least length at once finds the same runs as dropping short ones.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Share of ordinary samples that the bounds may call random.
FALSE_RATE = 0.002
#: Share of random samples that they may miss, where that can be had with it.
MISS_RATE = 0.01
KINDS = ("assign", "access", "hex", "markov")
#: Candidate strings of the models.
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
#: Character classes of the models: itself for a letter, digit or one of +/_=-; one class for all else.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Parts of ordinary identifiers, joined to labelled samples by rule.
PARTS = (
    "get set is has on to from with by for the and not new old max min num count size len index key value name type data file path "
    "user account order item list map node tree table row column field record batch stream buffer cache queue event message request "
    "response server client session config option default error warning status result report total average start end begin finish "
    "create update delete insert select query filter group sort merge join split parse format print write read load save open close "
    "connect register handler manager factory builder service controller model view template component module package library version "
    "number string integer boolean double array object class method function parameter argument return public private static final"
).split()


@dataclass(frozen=True)
class MarkovRatio:
    """ratio[a * n + b]: log-likelihood ratio of character b after a, random over ordinary; start[b] for the first."""

    start: tuple[float, ...]
    ratio: tuple[float, ...]
    #: A token counts as random if its ratio is over this.
    bound: float = 0.0
    #: The same for a token without a digit, most of which are words.
    letters: float = 0.0


LOWER, CAPITALS, DIGITS = ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62]
#: What random strings are made of: hex of either case, base 32, base 36, base 62 and base 64.
KEYS = (DIGITS + "abcdef", DIGITS + "ABCDEF", CAPITALS + "234567", LOWER + DIGITS, LOWER + CAPITALS + DIGITS, LOWER + CAPITALS + DIGITS + "+/", LOWER + CAPITALS + DIGITS + "-_")
#: The same for strings of letters alone.
LETTERS = (LOWER, CAPITALS, LOWER + CAPITALS)


def random_samples(n: int = 4_000, seed: int = 11, kinds: Sequence[str] = KEYS) -> list[str]:
    """Labelled random strings of each of the kinds in turn, of 16 to 64 characters."""
    rng = random.Random(seed)
    return ["".join(rng.choice(kinds[i % len(kinds)]) for _ in range(rng.randint(16, 64))) for i in range(n)]


def ordinary_samples(n: int = 4_000, seed: int = 12) -> list[str]:
    """Labelled identifiers: words joined in snake, kebab, camel, Pascal, constant and path form, some with a number."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = [rng.choice(PARTS) for _ in range(rng.randint(2, 6))]
        kind = i % 6
        s = ("_", "-", "", "", "_", "/")[kind].join(w.upper() if kind == 4 else w.title() if kind == 3 or (kind == 2 and j) else w for j, w in enumerate(words))
        out.append(s + (str(rng.randint(0, 9999)) if i % 5 == 0 else ""))
    return out


def _counts(samples: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    n = len(ALPHABET) + 1
    at = {c: i for i, c in enumerate(ALPHABET)}
    first, pairs = np.zeros(n), np.zeros((n, n))
    for s in samples:
        ids = [at.get(c, n - 1) for c in s]
        first[ids[0]] += 1
        np.add.at(pairs, (ids[:-1], ids[1:]), 1)
    return first, pairs


def _classes(word: Column) -> Column:
    """A string's character classes, from 0."""
    return F.transform(F.split(word, ""), lambda c: (F.instr(F.lit(ALPHABET), c) + len(ALPHABET)) % (len(ALPHABET) + 1))


def letter_pairs(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """How often each pair of neighbouring letters stands in words of letters alone, of four characters or more, of all documents.

    One pass; every task adds up its pairs, so at most 52**2 rows of it are shuffled, and as many come to the driver.
    """
    words = docs.select(F.explode(F.regexp_extract_all(text_of(text), F.lit(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{4,}(?![A-Za-z0-9+/_=-])"), F.lit(0))).alias("w"))
    # a place is found by reading from the word's beginning, so long words are cut into parts that overlap by a letter
    part = F.when(F.length("w") <= 64, F.array("w")).otherwise(F.regexp_extract_all("w", F.lit("(?=([A-Za-z]{1,64}))[A-Za-z]{1,63}"), F.lit(1)))
    words = words.select(F.explode(part).alias("w")).where(F.length("w") > 1)
    pairs = words.select("w", F.explode(F.sequence(F.lit(1), F.length("w") - 1)).alias("i")).select(F.expr("substring(w, i, 2)").alias("p"))
    return {r["p"]: r["n"] for r in pairs.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}


def _chained(pairs: np.ndarray, n: int, seed: int = 13) -> list[str]:
    """n words of 16 to 32 letters that follow each other as often as the counts say: long words like a corpus's."""
    rng, out = np.random.default_rng(seed), []
    letters = pairs[:52, :52]
    if not letters.sum():
        return []
    after, first = np.cumsum(letters + 1e-9, 1), np.cumsum(letters.sum(1))
    for _ in range(n):
        own = [int(np.searchsorted(first, rng.random() * first[-1]))]
        while len(own) < 16 or (len(own) < 32 and rng.random() > 0.2):
            row = after[own[-1]]
            own.append(int(np.searchsorted(row, rng.random() * row[-1])))
        out.append("".join(ALPHABET[i] for i in own))
    return out


def ratio_of(token: str, model: MarkovRatio) -> float:
    """log_ratio() off Spark."""
    n = len(ALPHABET) + 1
    at = {c: i for i, c in enumerate(ALPHABET)}
    ids = [at.get(c, n - 1) for c in token]
    return model.start[ids[0]] + sum(model.ratio[a * n + b] for a, b in zip(ids, ids[1:], strict=False))


def _squeezed(token: str) -> str:
    return re.sub(r"([+/_=-])[+/_=-]+", r"\1", token.strip("+/_=-"))


def fit(docs: DataFrame, text: str = "text", false_rate: float = FALSE_RATE) -> MarkovRatio:
    """The models: random strings made by rule against identifiers made by rule and words of all documents.

    Three quarters of the labelled samples are counted. The bounds are fitted on the last quarter: each lies
    midway between what `false_rate` of the ordinary ones exceed and what MISS_RATE of the random ones don't, or at the former if that
    is higher. Strings without a digit have a bound of their own, where the ordinary ones are joined by words chained from
    the documents' own letter pairs. Documents give letter_pairs() alone, so no secret of the corpus is learned as ordinary.
    """
    n = len(ALPHABET) + 1
    found = letter_pairs(docs, text)
    rand, plain = random_samples(), ordinary_samples()
    learned = lambda x: [s for i, s in enumerate(x) if i % 4 != 3]
    rand_first, rand_pairs = _counts(learned(rand))
    word_first, ordinary = _counts(learned(plain))
    corpus = np.zeros((n, n))
    for p, k in found.items():
        corpus[ALPHABET.index(p[0]), ALPHABET.index(p[1])] = k
    ordinary = ordinary + corpus * (ordinary.sum() / max(corpus.sum(), 1))  # the corpus weighs as much as the identifiers
    smooth = lambda x: (x + 0.5) / (x + 0.5).sum(-1, keepdims=True)
    ratio = np.log(smooth(rand_pairs)) - np.log(smooth(ordinary))
    start = np.log(smooth(rand_first)) - np.log(smooth(word_first))
    model = MarkovRatio(tuple(map(float, start.round(6))), tuple(map(float, ratio.ravel().round(6))))
    held = [s for s in plain[3::4] if len(s) >= 16]
    digit = [s for s in held if any(c in DIGITS for c in s)]
    words = [_squeezed(s) for s in held if s not in digit] + _chained(corpus, 2_000)
    scores = lambda own: [ratio_of(s, model) for s in own] or [0.0]

    def between(ordinary: list[str], random_ones: list[str]) -> float:
        low, high = np.quantile(scores(ordinary), 1 - false_rate), np.quantile(scores(random_ones), MISS_RATE)
        return round(float(max(low, (low + high) / 2)), 6)

    return replace(model, bound=between(digit, rand[3::4]), letters=between(words, random_samples(1_000, 14, LETTERS)))


def _numbers(values: Sequence[float]) -> Column:
    """A constant array, folded once when the plan is made."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def log_ratio(token: Column, model: MarkovRatio) -> Column:
    """The token's log-likelihood ratio, random over ordinary."""
    n = len(ALPHABET) + 1
    begin = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("last"))
    start, ratio = _numbers(model.start), _numbers(model.ratio)
    step = lambda a, c: F.struct((a["sum"] + F.when(a["last"] < 0, F.element_at(start, c + 1)).otherwise(F.element_at(ratio, a["last"] * n + c + 1))).alias("sum"), c.alias("last"))
    return F.aggregate(_classes(token), begin, step, lambda a: a["sum"])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once. (A column used inside a lambda is worked out anew for every element.)"""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, plus: Callable[[Column, Column], Column]) -> Column:
    """For each value of an array of ints, plus() over those before it, from 0.

    Values are taken in blocks of about the square root of their number: arrays grow by copying, so one run over n of them would copy n * n / 2.
    """

    def blocks(v: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1))
        grow = lambda a, x: F.concat(a, F.array(plus(F.element_at(a, -1), x)))
        own = let(width, lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), w), lambda i: F.aggregate(F.slice(v, i + 1, w), F.array(F.lit(0)), grow)))
        before = lambda b: F.aggregate(b, F.array(F.lit(0)), lambda a, x: grow(a, F.element_at(x, -1)))
        moved = lambda b, o: F.transform(F.slice(b, F.lit(1), F.size(b) - 1), lambda x: plus(o, x))
        return let(own, lambda b: F.flatten(F.zip_with(b, F.slice(before(b), F.lit(1), F.size(b)), moved)))

    return let(values, blocks)


def _spans(text: Column, pattern: str, kind: int, keep: Callable[[Column], Column]) -> Column:
    """Spans of the pattern's leftmost matches, one after the other, for which keep(match) holds.

    The text between matches is what split() leaves, so its lengths and the matches' give each match's place, in code points.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast(SPANS)

    def placed(hits: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern), F.lit(1), F.size(hits)), F.length)
        steps = lambda g: F.zip_with(g, hits, lambda n, h: n + F.length(h))
        from_ = let(gaps, lambda g: F.zip_with(running(steps(g), lambda a, b: a + b), g, lambda a, n: a + n))
        span = lambda at, h: F.struct(at.alias("start"), F.lit(kind).alias("kind"), (at + F.length(h)).alias("end"), h.alias("hit"))
        return F.filter(F.zip_with(from_, hits, span), lambda x: keep(x["hit"])).cast(SPANS)

    return let(found, lambda hits: F.when(F.size(hits) > 0, placed(hits)).otherwise(none))


SPANS = "array<struct<start:int,kind:int,end:int,hit:string>>"


def _not_named_again(spans: Column) -> Column:
    """The spans without those of the models that have the place of a span of the fixed patterns: sorted by place, each is looked at beside the one before it."""
    by_place = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["hit"].alias("hit"))))
    again = lambda s, b: (s["kind"] == 3) & (s["start"] == b["start"]) & (s["end"] == b["end"])
    marked = lambda own: F.zip_with(own, F.concat(F.slice(own, 1, 1), own), lambda s, b: F.when(s.isNotNull() & ~again(s, b), s))
    # (the first is looked at beside itself: as a span of the models it would be taken out, so it stands beside nothing)
    first = lambda own: F.filter(F.slice(own, 1, 1), lambda s: s["kind"] == 3)
    return let(by_place, lambda own: F.concat(first(own), F.filter(marked(own), lambda s: s.isNotNull())))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, model: MarkovRatio, text: str = "text", out: str = "secrets") -> DataFrame:
    """Adds `out`: the text's secret spans as an array of (start, kind, end, hit), by start, then kind as in KINDS.

    Kinds assign, access and hex are the fixed patterns' leftmost non-overlapping matches; kind markov are strings of
    TOKEN that hold a letter, or a digit and something else, whose log-likelihood ratio is over the model's bound (`letters` for those without a digit).
    They may overlap spans of the fixed patterns (the value of an assignment), but one equal to such a span isn't named again.
    Places are code points, ends exclusive. Null and empty texts have no spans; repeated rows have equal ones; a column of
    the name `out` is replaced, all others stay, whatever their names. One pass, no shuffle, no Python.
    """
    # ruled lines around words aren't random: without a digit, runs of +/_=- count once, and not at all at the ends
    core = lambda h: F.regexp_replace(F.regexp_replace(h, "^[+/_=-]+|[+/_=-]+$", ""), "([+/_=-])[+/_=-]+", "$1")
    digit = lambda h: h.rlike("[0-9]")
    over = lambda h: log_ratio(F.when(digit(h), h).otherwise(core(h)), model) > F.when(digit(h), F.lit(model.bound)).otherwise(F.lit(model.letters))

    def work(df: DataFrame) -> DataFrame:
        t = F.col("t")
        df = df.withColumns({
            "assign": _spans(t, ASSIGN, 0, lambda h: F.length(F.regexp_extract(h, ASSIGN, 2)) >= ASSIGN_LEAST),
            "access": _spans(t, ACCESS, 1, lambda h: F.lit(True)),
            "hex": _spans(t, HEX, 2, lambda h: F.lit(True)),
            "token": _spans(t, TOKEN, 3, lambda h: h.rlike("[A-Za-z]") | (h.rlike("[0-9]") & h.rlike("[^0-9]"))),
        })
        own = F.filter(_not_named_again(F.concat("assign", "access", "hex", "token")), lambda s: (s["kind"] < 3) | over(s["hit"]))
        in_order = F.sort_array(F.transform(own, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["hit"].alias("hit"))))
        return df.withColumn("found", in_order)

    return beside(docs, {"t": text_of(text)}, work, {out: "found"})


def redacted(docs: DataFrame, text: str = "text", spans: str = "secrets", mark: str = "[SECRET]") -> DataFrame:
    """The text with every secret span replaced by `mark`; overlapping spans go together.

    Null texts stay null, texts without spans as they are, repeated rows alike; all other columns stay, whatever their names. What lies between spans is cut out in
    blocks of about the square root of their number, as cutting reads a text from its beginning.
    """
    t, found = F.col(f"`{text}`"), F.col(f"`{spans}`")
    before = running(F.transform(found, lambda s: s["end"]), F.greatest)
    gap = lambda s, b: F.when(s["start"] >= b, F.struct(b.alias("a"), s["start"].alias("b")))
    gaps = F.filter(F.zip_with(found, before, gap), lambda g: g.isNotNull())

    def cut(part: Column) -> Column:
        begin = part[0]["a"]
        return let(F.substring(t, begin + 1, F.element_at(part, -1)["b"] - begin), lambda own: F.transform(part, lambda g: F.substring(own, g["a"] - begin + 1, g["b"] - g["a"])))

    def pieces(g: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(g))).cast("int")
        return F.flatten(let(width, lambda w: F.transform(F.sequence(F.lit(0), F.size(g) - 1, w), lambda i: let(F.slice(g, i + 1, w), cut))))

    end = F.array_max(F.transform(found, lambda s: s["end"]))
    done = F.concat(F.array_join(let(gaps, pieces), mark), F.lit(mark), F.substring(t, end + 1, F.length(t)))
    return docs.withColumn(text, F.when(F.size(found) > 0, done).otherwise(t))
