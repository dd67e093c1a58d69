"""Quality classifier: a sparse rule ensemble over text statistics, compiled into Spark column expressions.

Trees are grown on a bounded sample of labelled rows; every path from a root becomes a conjunctive rule; a
lasso-penalised logistic regression keeps few of them; those are compiled into one column expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamesh.llm._io import BLANK, WORD, text_of

#: Labelled rows that the model is fitted on, at most (those with the smallest hashes of their ids).
MAX_FIT_ROWS = 6_000


def _share(text: Column, kept: str) -> Column:
    """Characters of the class over all characters."""
    return F.length(F.regexp_replace(text, f"[^{kept}]+", "")) / F.greatest(F.length(text), F.lit(1))


def statistics(text: Column) -> dict[str, Column]:
    """Name -> statistic of the whole text. Texts without characters or words have zeros, never nulls."""
    words = F.filter(F.split(text, f"[{BLANK}]+"), lambda w: w != "")
    lines = F.split(text, "\n")
    return {
        "chars": F.length(text).cast("double"),
        "upper": _share(text, r"\p{Lu}"),
        "digit": _share(text, "0-9"),
        "symbol": _share(text, "#*$%&"),
        "exclaim": _share(text, "!?"),
        "bars": _share(text, "|<>{}"),
        "stops": _share(text, ".,;:"),
        "words": F.size(words).cast("double"),
        "word_kinds": F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1)),
        "word_chars": F.length(F.regexp_replace(text, f"[{BLANK}]+", "")) / F.greatest(F.size(words), F.lit(1)),
        "lines": F.size(lines).cast("double"),
        "line_kinds": F.size(F.array_distinct(lines)) / F.size(lines),
        "stop_lines": F.regexp_count(text, F.lit(r"[.!?](?:\n|\z)")) / F.size(lines),
    }


@dataclass(frozen=True)
class Rule:
    #: (statistic, whether it must be over the bound, bound)
    tests: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def column(self) -> Column:
        out = F.lit(True)
        for name, over, bound in self.tests:
            out = out & ((F.col(name) > bound) if over else (F.col(name) <= bound))
        return out


@dataclass(frozen=True)
class RuleEnsemble:
    bias: float
    rules: tuple[Rule, ...] = field(default=())

    def score(self) -> Column:
        """The probability of label 1, over columns named like the statistics."""
        margin = F.lit(self.bias)
        for r in self.rules:
            margin = margin + F.when(r.column(), F.lit(r.weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def _grow(over: np.ndarray, gradient: np.ndarray, curve: np.ndarray, rows: np.ndarray, depth: int, least: int) -> list:
    """A regression tree as nested [(column, left, right)] or a step; over[i, c]: row i is over the c-th bound."""
    g, h = gradient[rows], curve[rows]
    step = -g.sum() / (h.sum() + 1.0)
    if depth == 0 or len(rows) < 2 * least:
        return [step]
    x = over[rows]
    gr, hr, nr = g @ x, h @ x, x.sum(0)
    gl, hl = g.sum() - gr, h.sum() - hr
    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
    gain[(nr < least) | (len(rows) - nr < least)] = -1
    c = int(gain.argmax())
    if gain[c] <= 1e-9:
        return [step]
    return [c, _grow(over, gradient, curve, rows[~x[:, c]], depth - 1, least), _grow(over, gradient, curve, rows[x[:, c]], depth - 1, least)]


def _walk(tree: list, path: tuple, found: dict, values: np.ndarray, over: np.ndarray, rows: np.ndarray) -> None:
    """Adds the tree's steps to values and its paths to found."""
    if path:
        found.setdefault(tuple(sorted(path)))
    if len(tree) == 1:
        values[rows] += tree[0]
        return
    c, left, right = tree
    hit = over[rows, c]
    _walk(left, (*path, (c, False)), found, values, over, rows[~hit])
    _walk(right, (*path, (c, True)), found, values, over, rows[hit])


def _lasso(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty on all but the bias, by accelerated proximal gradient steps."""
    n, m = x.shape
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    bias, w = float(np.log(share / (1 - share))), np.zeros(m)
    rate = 4.0 / (1 + np.linalg.norm(x, 2) ** 2 / n) if m else 4.0
    zb, z, t = bias, w.copy(), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(zb + x @ z, -30, 30)))
        new = z - rate * (x.T @ (p - y) / n)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        nb = zb - rate * float((p - y).mean())
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, zb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - bias)
        w, bias, t = new, nb, t2
    return bias, w


def fit_rules(names: list[str], x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, bounds: int = 12, penalty: float = 0.001, seed: int = 7) -> RuleEnsemble:
    """The ensemble of labelled statistics. Without rows, or with one label only, it has a bias and no rules."""
    if not len(y):
        return RuleEnsemble(0.0)
    if y.min() == y.max():
        return RuleEnsemble(4.0 if y[0] else -4.0)
    cuts = [(j, float(b)) for j in range(x.shape[1]) for b in np.unique(np.quantile(x[:, j], np.linspace(0, 1, bounds + 2)[1:-1]))]
    over = np.stack([x[:, j] > b for j, b in cuts], 1)
    rng, margin, found = np.random.default_rng(seed), np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        rows = np.flatnonzero(rng.random(len(y)) < 0.7)
        tree = _grow(over, p - y, p * (1 - p), rows, depth, max(5, len(y) // 400))
        step = np.zeros(len(y))
        _walk(tree, (), found, step, over, np.arange(len(y)))
        margin += 0.5 * step
    paths, seen = [], set()
    for path in found:
        hit = np.logical_and.reduce([over[:, c] == side for c, side in path])
        if 0 < hit.sum() < len(y) and (key := hit.tobytes()) not in seen:
            seen.add(key)
            paths.append((path, hit))
    if not paths:
        return RuleEnsemble(float(margin.mean()))
    bias, w = _lasso(np.stack([h for _, h in paths], 1).astype(float), y.astype(float), penalty)
    kept = [Rule(tuple((names[cuts[c][0]], side, cuts[c][1]) for c, side in path), float(v)) for (path, _), v in zip(paths, w, strict=True) if v]
    return RuleEnsemble(bias, tuple(kept))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", max_rows: int = MAX_FIT_ROWS) -> RuleEnsemble:
    """The ensemble of at most max_rows labelled documents: those with the smallest hashes of their keys.

    Null keys and labels aren't used; a key that stands more than once counts once, with the greatest of its labels and
    rows of numbers. The driver gets max_rows rows of numbers.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(label).alias("_label"))
    chosen = known.orderBy(F.xxhash64("_key"), "_key").limit(max_rows)
    rows = docs.select(F.col(key).alias("_doc"), text_of(text).alias("_text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_key"))
    stats = statistics(F.col("_text"))
    names = list(stats)
    # one row a key before the driver gets any: a table may hold a labelled row any number of times
    got = rows.select("_key", "_label", F.struct(*(c.alias(k) for k, c in stats.items())).alias("_stats")).groupBy("_key", "_label").agg(F.max("_stats").alias("_stats")).collect()
    got = sorted(got, key=lambda r: r["_key"])
    x = np.array([[float(r["_stats"][k]) for k in names] for r in got]).reshape(len(got), len(names))
    return fit_rules(names, x, np.array([int(r["_label"] > 0) for r in got]))


def score(docs: DataFrame, model: RuleEnsemble, text: str = "text", out: str = "score") -> DataFrame:
    """Adds `out`, the probability of label 1, from the whole text: one pass on the JVM, no shuffle, no Python.

    Null texts count as empty and get a score like any other; repeated rows get equal scores. A column of the name
    `out` is replaced, all others stay, whatever their names.
    """
    stats = statistics(F.col("_x"))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    inner = docs.select(whole, text_of(text).alias("_x")).select("_row", *(c.alias(k) for k, c in stats.items()))
    kept = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c != out]
    return inner.select("_row", model.score().alias("_score")).select(*kept, F.col("_score").alias(out))
