"""Each operator against a brute-force version, and on odd rows: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import math
import random
import re
import textwrap
import time
import zlib

import numpy as np
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from stratamesh.llm import licences, line_crf, near_dedup, order_minhash, packing, pieces, quality_model, secrets, sharding, urlfilter
from stratamesh.llm._io import table, written
from stratamesh.llm.components import components

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SENTENCES = public_tokenizers.path("piece_bpe_32k.model")
LONG = "lorem ipsum dolor sit amet " * 8_000
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Ünïcode \U0001f600 text\x00\x85\xa0 x"), (6, LONG), (None, "no id here at all"), (7, "twice the same row"), (7, "twice the same row"), (8, "twice the same row")]


def docs(spark, rows=ODD):
    return spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, shard int, score string")


def empty(spark):
    return docs(spark).limit(0)


# --- fingerprints


def test_order_minhash_edits(spark):
    got = order_minhash.with_next(docs(spark)).collect()
    rows = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for i, (k, t) in enumerate(rows):
        t, n = t or "", rows[(i + 1) % len(rows)][1] or ""
        e = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        a, b, c = map(order_minhash.sketch, (t, e, n))
        want.append((k, len(t), hashlib.sha256(e.encode()).hexdigest(), order_minhash.fingerprint(a), order_minhash.fingerprint(b), order_minhash.likeness(a, b), order_minhash.likeness(a, c)))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert order_minhash.with_next(empty(spark)).count() == 0
    one = order_minhash.with_next(docs(spark, [(4, "abcdefgh")])).first()
    assert one["near_next"] == 1 and one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()


def test_order_minhash_many_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 10**12), f"text {i} " * rng.randint(0, 9)) for i in range(500)]
    got = {r["doc_id"]: r["edited_sha256"] for r in order_minhash.with_next(docs(spark, rows)).collect()}
    rows.sort()
    for i, (k, t) in enumerate(rows):
        assert got[k] == hashlib.sha256(order_minhash.edited(t, rows[(i + 1) % 500][1]).encode()).hexdigest()


def test_order_minhash_likeness():
    rng = random.Random(2)
    a = "".join(rng.choice("abcdefghij ") for _ in range(2000))
    s = order_minhash.sketch(a)
    near = [order_minhash.likeness(s, order_minhash.sketch(a[: 2000 - n] + "z" * n)) for n in (0, 40, 400, 1500)]
    assert near[0] == 1 and near[0] > near[1] > near[2] > near[3]
    swapped = order_minhash.sketch(a[1000:] + a[:1000])
    assert order_minhash.likeness(s, swapped) < near[1]
    assert order_minhash.likeness(order_minhash.sketch("a" * 50), order_minhash.sketch("a" * 500)) < 1
    for w in (1, 3, 8, 11):
        c = np.frombuffer("abcabcabcabcabc".encode("utf-32-le"), np.uint32)
        k = order_minhash._kmers(c, w)
        assert len(k) == 16 - w and len(set(k.tolist())) == min(3, 16 - w)


def naive_fingerprint(text: str) -> str:
    """Order MinHash in plain integers: every k-mer with its number among its equals, the least two of each order, in text order."""
    m64 = (1 << 64) - 1

    def mix(h: int) -> int:
        h = (h ^ h >> 32) * 0x9FB21C651E98DF25 & m64
        return h ^ h >> 29

    w, seen, items = min(order_minhash.WIDTH, len(text)), {}, []
    for i in range(len(text) - w + 1):
        h = 0
        for c in text[i : i + w]:
            h = (h * order_minhash._BASE + ord(c) + 1) & m64
        h = mix(h) & ~((1 << order_minhash._AT) - 1)
        seen[h] = seen.get(h, -1) + 1
        items.append((mix(h | seen[h]), h, i))
    out = b""
    for j, (a, b) in enumerate(zip(order_minhash._A.tolist(), order_minhash._B.tolist(), strict=True)):
        least = sorted(items, key=lambda x: ((a * (x[0] >> 32) + b) % (1 << 32), x[1], x[2]))[: order_minhash.TUPLE]
        v = len(least)
        for item, _, _ in sorted(least, key=lambda x: x[2]):
            v = mix((v ^ item) * 0x9E3779B97F4A7C15 + j & m64)
        out += (v >> 48 | 1).to_bytes(2, "big")
    return out.hex()


@pytest.mark.parametrize("text", ["a", "abcdefg", "abcdefgh", "abcdefghi", "ab" * 300, "The quick brown fox jumps over the lazy dog; " * 5, "".join(map(chr, range(33, 900))), "ß😀" * 40])
def test_order_minhash_equals_brute_force(text):
    assert order_minhash.fingerprint(order_minhash.sketch(text)) == naive_fingerprint(text)


def test_order_minhash_of_very_long_texts():
    rng = np.random.default_rng(14)
    for h in (rng.integers(0, 1 << 63, 4000, dtype=np.uint64), order_minhash._mixed(rng.integers(0, 50, 4000, dtype=np.uint64))):
        for a, b in zip(order_minhash._sorted(h, True), order_minhash._sorted(h, False), strict=True):
            assert (a == b).all()
    n = (1 << order_minhash._AT) + 100
    text = rng.integers(97, 123, n, dtype=np.uint8).tobytes().decode()
    long = order_minhash.sketch(text)
    assert order_minhash.likeness(long, order_minhash.sketch(text[: n - 200])) > 0.9
    assert order_minhash.likeness(long, order_minhash.sketch(text[n // 2 :] + text[: n // 2])) < 0.9
    items = order_minhash._numbered(np.zeros(n, np.uint64))
    assert len(np.unique(items)) == n and (items[:1000] == order_minhash._numbered(np.zeros(1000, np.uint64))).all()


def test_fingerprint_column(spark):
    got = [r["fingerprint"] for r in order_minhash.fingerprints(docs(spark)).orderBy("doc_id").collect()]
    assert len(got) == len(ODD) and len({r["fingerprint"] for r in order_minhash.fingerprints(docs(spark)).where("doc_id > 6").collect()}) == 1


# --- licences


def test_licences(spark):
    for family, texts in licences.TEMPLATES.items():
        for t in texts:
            assert licences.classify(t)[0] == family
    assert all(licences.classify(t)[0] is None for t in licences.ORDINARY)
    rows = [*ODD, (20, "a\n\nReleased under the MIT License.\nmy driving license\nLICENSED UNDER CC BY-NC 4.0."), (21, LONG + "\nAll rights reserved.")]
    got = {r["doc_id"]: [tuple(x)[:2] for x in r["licences"] if x["confirmed"]] for r in licences.scan(docs(spark, rows).withColumn("licences", F.lit(1))).collect()}
    assert got[20] == [(2, "mit"), (4, "cc-by-nc")] and got[21] == [(1, "proprietary")]
    assert not any(v for k, v in got.items() if k not in (20, 21))
    one = licences.scan(docs(spark, [(1, "Released under the MIT License.")])).first()["licences"][0]
    assert one["probability"] == pytest.approx(licences.classify("Released under the MIT License.")[1])
    assert licences.scan(empty(spark)).count() == 0


def test_licence_names(spark):
    lines = {
        "gpl": ("Released under GPLv3", "Licensed under the GPLv2", "SPDX-License-Identifier: GPL-3.0-or-later"),
        "lgpl": ("LGPL-2.1-only", "GNU LGPL v2.1"), "agpl": ("Licensed under the AGPLv3", "AGPL-3.0-only"), "epl": ("Distributed under the EPL 2.0",),
        "mit": ("MIT", "SPDX-License-Identifier: MIT", "Distributed under the MIT"), "isc": ("ISC", "SPDX-License-Identifier: ISC"),
        "zlib": ("SPDX-License-Identifier: Zlib",), "unlicense": ("Unlicense", "Released under the Unlicense"),
    }
    rows = [(i, f"Some text.\n{t}\nmore", f) for i, (f, t) in enumerate((f, t) for f, own in lines.items() for t in own)]
    got = {r["doc_id"]: [tuple(x)[:2] + (x["confirmed"],) for x in r["licences"]] for r in licences.scan(docs(spark, [r[:2] for r in rows])).collect()}
    for i, t, f in rows:
        assert got[i] == [(1, f, True)], t
    plain = ["Mit.", "mit", "komm doch mit", "Er ging mit den anderen fort.", "The EPL season is over.", "HALLO", "released", "the license"]
    assert not any(r["licences"] for r in licences.scan(docs(spark, list(enumerate(plain)))).collect())


MIT_NOTICE = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions."""
GPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""


@pytest.mark.parametrize("width", [45, 60, 72, 100])
def test_wrapped_notices_are_found_whole(spark, width):
    wrap = lambda t, mark="": "\n".join(mark + x for x in textwrap.wrap(t, width))
    rows = []
    for family, notice in (("mit", MIT_NOTICE), ("gpl", GPL_NOTICE)):
        for mark in ("", "# ", " * ", "// "):
            text = wrap(notice, mark)
            rows += [(text, family), (text.upper(), family), ("Some words of a heading\n\n" + text + "\n\nIt went on in another way.", family)]
    got = {r["doc_id"]: r["licences"] for r in licences.scan(docs(spark, [(i, t) for i, (t, _) in enumerate(rows)])).collect()}
    for i, (t, family) in enumerate(rows):
        assert [(r["family"], r["confirmed"]) for r in got[i]] == [(family, True)], t


def test_licences_never_seen():
    """Sentences of no template: families are told, other licences and ordinary use of the same words are not."""
    model = licences.train()
    known = {
        "Licensed under the MIT licence": "mit", "This module is covered by the MIT License": "mit", "This file is licensed under the GNU GPL version 2": "gpl", "You may use it under the GNU General Public License": "gpl",
        "Covered by the Apache 2.0 licence": "apache", "The Apache License, Version 2.0 applies to all files": "apache", "Use is governed by a BSD-style license found in the LICENSE file": "bsd", "Text is available under CC BY-SA 4.0": "cc-by",
        "Images are under CC BY-NC 4.0": "cc-by-nc", "The library is under the GNU Lesser General Public License": "lgpl", "Offered under the GNU Affero General Public License": "agpl", "Code under the Mozilla Public License 2.0": "mpl",
        "Made available under the Eclipse Public License v2.0": "epl", "Copyright 2018 Some Publisher. All rights reserved.": "proprietary",
    }
    other = ["Licensed under the Open Software License 3.0", "Licensed under the Q Public License", "Released under the Sleepycat License", "Distributed under the Zope Public License 2.1", "Her driving licence was revoked in the spring.", "Permission to leave was granted free of charge.", "The public was generally free to use the software room.", "Version 2 of the report was released under pressure.", "All seats were reserved, and all rights respected.", "The foundation published the terms of the prize."]
    right = sum(licences.classify(t, model)[0] == f for t, f in known.items())
    wrong = [t for t in other if licences.classify(t, model)[0] and licences.classify(t, model)[1] >= 0.5]
    assert right >= 13 and len(wrong) <= 1, ([(t, licences.classify(t, model)) for t, f in known.items() if licences.classify(t, model)[0] != f], wrong)


def test_licence_scores_equal_plain_sums(spark):
    """The plan's probabilities against sums over words and pairs of neighbours, made without the scan's own code."""
    model, rng = licences.train(), random.Random(17)
    grams, filler = sorted(model.weights), [w for x in licences.ORDINARY for w in re.findall("[a-z0-9]+", x.lower())]
    texts = [" ".join(rng.choice(grams if rng.random() < 0.6 else filler) for _ in range(rng.randint(2, 9))).replace("=", "") for _ in range(300)]
    got = {r["doc_id"]: r["licences"] for r in licences.scan(docs(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        words = re.findall("[a-z0-9]+", t)
        own = set(words) | {f"{a} {b}" for a, b in zip(words, words[1:])}
        z = [b + sum(model.weights[g][c] for g in own if g in model.weights) for c, b in enumerate(model.bias)]
        e = [math.exp(v / model.temperature) for v in z]
        best = max(range(len(e)), key=lambda c: e[c])
        want = [(licences.FAMILIES[best], pytest.approx(e[best] / sum(e)))] if best < len(licences.FAMILIES) and e[best] / sum(e) >= 0.5 else []
        if len(words) > 1:
            assert [(r["family"], r["probability"]) for r in got[i]] == want, t


def test_licence_prefilter_loses_nothing(spark):
    model, rng = licences.train(), random.Random(13)
    grams, filler = sorted(model.weights), licences.words_of(" ".join(licences.ORDINARY))
    texts = [" ".join(rng.choice(grams if rng.random() < 0.5 else filler) for _ in range(rng.randint(1, 9))) for _ in range(1500)]
    texts = [t.upper() if i % 3 == 0 else t for i, t in enumerate(texts)]
    fits = {r["doc_id"] for r in docs(spark, list(enumerate(texts))).where(F.lower("text").rlike(licences.prefilter(model))).collect()}
    listed = {i for i, t in enumerate(texts) if licences.classify(t, model)[0]}
    assert listed <= fits and len(listed) > 100


# --- packing


def places(plan, counts):
    out = []
    for length, n in counts.items():
        k = (length << 44) + np.arange(n)
        step = np.searchsorted(plan.key, k, "right") - 1
        out += [(int(b), int(o), length) for b, o in zip(plan.bin[step] + k - plan.key[step], plan.offset[step])]
    return sorted(out)


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("capacity", [packing.Capacity(100), packing.Capacity(100, 4), packing.Capacity(100, 6, 5_000)])
def test_plan_keeps_every_capacity(rule, capacity):
    rng = np.random.default_rng(0)
    lengths = np.minimum(rng.geometric(0.04, 3000), 70)
    counts = {int(a): int(b) for a, b in zip(*np.unique(lengths, return_counts=True))}
    plan = packing.plan_bins(counts, capacity, rule)
    bins: dict = {}
    for b, o, n in places(plan, counts):
        assert o == sum(bins.setdefault(b, []))
        bins[b].append(n)
    assert sorted(bins) == list(range(plan.bins))
    for own in bins.values():
        assert sum(own) <= 100 and len(own) <= (capacity.documents or 100) and sum(n * n for n in own) <= (capacity.attention or 10**9)
    least = max(sum(lengths) / 100, len(lengths) / (capacity.documents or 1e9), sum(int(n) ** 2 for n in lengths) / (capacity.attention or 1e12))
    assert plan.bins <= least * (1.25 if capacity.documents == 4 else 1.12) + 1


def test_plan_refuses():
    with pytest.raises(ValueError):
        packing.plan_bins({11: 1}, packing.Capacity(10))
    assert packing.plan_bins({}, packing.Capacity(10)).bins == 0


def test_token_pieces_and_pack(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    rows = [*ODD, (30, "It's ΣΑΣ <|endoftext|> 12 don't; İstanbul\u0301 ﬁne"), (31, "we'll we'LL they're x's 3's a.b-c_d \u00aa\u00ba")]
    got = packing.pack(packing.token_pieces(docs(spark, rows), WORDS, limit=500), capacity=packing.Capacity(500)).collect()
    want = []
    for k, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        want += [(k, i, s, len(ids[s : s + 500]), zlib.crc32(np.array(ids[s : s + 500], "<u4").tobytes())) for i, s in enumerate(range(0, len(ids), 500))]
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, want))
    bins: dict = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == bins.get(r["sequence_id"], 0)
        bins[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(bins.values()) <= 500 and len(bins) == -(-sum(r[3] for r in want) // 500)
    assert packing.pack(packing.token_pieces(empty(spark), WORDS)).count() == 0


def test_word_tokens_in_little_memory():
    from tokenizers import Tokenizer

    from stratamesh.llm.word_tokens import WordTokens

    t, rng = Tokenizer.from_file(WORDS), random.Random(21)
    pool = ["".join(rng.choice("abcdefghijéüñÅ,.!'19&") for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    small, large = WordTokens(WORDS, 3000), WordTokens(WORDS)
    for i in range(12):
        texts = ["", "   \n ", *(" ".join(rng.choice(pool) for _ in range(rng.randint(1, 200))) for _ in range(20)), "İ\u0301 no plain <|endoftext|>", "x" * 5000]
        want = [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
        assert small.encode(texts) == want and large.encode(texts) == want
        assert pc.binary_length(small.words).to_numpy().sum() <= 3000
    assert small.encode([]) == []


def test_pack_extra_columns(spark):
    df = spark.createDataFrame([(1, 0, 0, 5, 9, "a", 3), (1, 0, 0, 5, 9, "a", 3)], "doc_id long, piece int, start long, length long, ids_crc32 long, source string, offset int")
    got = packing.pack(df, capacity=packing.Capacity(10)).collect()
    assert [r["source"] for r in got] == ["a", "a"] and sorted(r["offset"] for r in got) == [0, 5]
    odd = packing.pack(df.withColumns({"_note": F.lit("n"), "size": F.lit(1), "rank": F.lit(2), "c0": F.lit(3), "sub": F.lit(4)}), capacity=packing.Capacity(10)).first()
    assert (odd["_note"], odd["size"], odd["rank"], odd["c0"], odd["sub"]) == ("n", 1, 2, 3, 4)
    with pytest.raises(ValueError):
        packing.pack(df.withColumn("length", F.lit(0).cast("long")))


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan_equals_naive_vector_best_fit(rule):
    """Piece by piece: of all open bins where it fits under every capacity, the best by the rule; a new one where none does."""
    rng, weights = np.random.default_rng(31), (1.0, 0.3, 0.5)
    for capacity in (packing.Capacity(60), packing.Capacity(60, 4, None), packing.Capacity(60, None, 1500), packing.Capacity(60, 3, 2000)):
        counts = {int(k): int(rng.integers(1, 6)) for k in rng.choice(np.arange(1, 39), 15, replace=False)}
        full = np.array([60, capacity.documents or 60, capacity.attention or 3600], float)
        w, bins = np.array(weights) / full**2, []
        for length in sorted(counts, reverse=True):
            need = np.array([length, 1, length**2], float)
            for _ in range(counts[length]):
                fit = [b for b in bins if (b >= need).all()]
                if fit:
                    cost = [(w * (b - need) ** 2).sum() if rule == "norm" else -(w * b * need).sum() for b in fit]
                    fit[int(np.argmin(cost))][:] -= need
                else:
                    bins.append(full - need)
        plan = packing.plan_bins(counts, capacity, rule, weights)
        assert abs(plan.bins - len(bins)) <= 1 and plan.bins <= 1.1 * len(bins)


# --- sentence pieces


def test_pieces_equal_the_library():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=SENTENCES)
    m = pieces.matcher_of(SENTENCES)
    rng = random.Random(3)
    texts = [t or "" for _, t in ODD] + ["  lead", "a     b", "▁x ▁▁ y", "<s></s><0x41>", "日本語 テスト", "x" * 400, "ab" * 300]
    texts += ["".join(rng.choice("ab  theing▁\n.,é日😀\x00") for _ in range(rng.randint(1, 80))) for _ in range(800)]
    got = m.encode(texts)
    for t, g in zip(texts, got):
        assert np.frombuffer(g, "<u4").tolist() == sp.encode(t), t
        assert m.decode(g) == sp.decode(sp.encode(t))
    m.known.clear()
    assert m.encode(texts) == got
    assert m.decode([]) == "" and m.decode([0xE4 + 3, 13]) == sp.decode([0xE4 + 3, 13])
    with pytest.raises(IndexError):
        m.decode([10**6])


@pytest.mark.parametrize("letters", ["abcdefghij", "aaaab", "etaoinshr", "abc漢é\U0001f600x\0", "0123456789=-", "a"])
def test_pieces_of_long_words(monkeypatch, letters):
    import sentencepiece

    monkeypatch.setattr(pieces, "PART", 3000)
    sp, m, rng = sentencepiece.SentencePieceProcessor(model_file=SENTENCES), pieces.PieceMatcher(SENTENCES), random.Random(7)
    for n in (pieces.LONG, pieces.LONG + 1, 3000, 6001, 10_000):
        text = f"so {''.join(rng.choice(letters) for _ in range(n))} on"
        ids = m.encode([text])[0]
        assert np.frombuffer(ids, "<u4").tolist() == sp.encode(text) and m.decode(ids) == text


def test_a_word_of_half_a_million_characters_takes_seconds():
    m, rng = pieces.matcher_of(SENTENCES), random.Random(8)
    word = "".join(rng.choice("etaoinshrdlu") for _ in range(500_000))
    began = time.process_time()
    assert m.decode(m.encode([word])[0]) == word and time.process_time() - began < 30


def test_pieces_columns(spark):
    rows = pieces.encoded(docs(spark), SENTENCES)
    back = {(r["doc_id"]): r["text"] for r in pieces.decoded(rows, SENTENCES).collect()}
    assert all(back[k] == (t or "") for k, t in ODD)
    assert {r["round_trip"] for r in pieces.digests(docs(spark), SENTENCES).collect()} == {True}
    assert pieces.encoded(empty(spark), SENTENCES).count() == 0


# --- sharding


def test_rendezvous(spark):
    rows = docs(spark, [*ODD, *[(i, f"t{i % 50}") for i in range(100, 4100)]])
    got = sharding.with_slots(sharding.rendezvous(rows, "doc_id", 8, grown="grown"), "doc_id", "shard", ["doc_id", "text"]).collect()
    assert len(got) == len(ODD) + 4000 and all(r["grown"] in (r["shard"], 8) for r in got)
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
        assert 400 < sum(r["shard"] == s for r in got) < 620
    more = {r["doc_id"]: r["shard"] for r in sharding.rendezvous(rows, "doc_id", 9).collect()}
    assert all(more[r["doc_id"]] == r["grown"] for r in got)
    for r in got[:50]:
        k = "null" if r["doc_id"] is None else str(r["doc_id"])
        assert r["shard"] == max(range(8), key=lambda i: (hashlib.md5(f"{k}:{i}".encode()).hexdigest()[:15], -i))
    heavy = [r["shard"] for r in sharding.rendezvous(rows, "doc_id", 3, [1, 1, 2]).collect()]
    assert 0.45 < heavy.count(2) / len(heavy) < 0.55
    lighter = [r["shard"] for r in sharding.rendezvous(rows, "doc_id", 3, [1, 1, 1.0001]).collect()]
    moved = [(a, b) for a, b in zip(lighter, heavy) if a != b]
    assert moved and all(b == 2 for _, b in moved)
    assert sharding.with_slots(sharding.rendezvous(empty(spark), "doc_id", 8), "doc_id", "shard", ["doc_id"]).count() == 0
    for bad in ((0, None), (2, [1]), (2, [1, -1])):
        with pytest.raises(ValueError):
            sharding.rendezvous(rows, "doc_id", *bad)


# --- quality rules


def base_brute(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {j for i, w in enumerate(wins) if wins.count(w) > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside)


def test_base_statistics():
    rng = random.Random(4)
    texts = [t or "" for _, t in ODD if t != LONG] + ["".join(rng.choice("ab \n\t#|\x85\u2003") for _ in range(rng.randint(0, 120))) for _ in range(400)]
    for t in texts:
        _, repeated, words = line_crf.read_lines(t)
        assert line_crf.base_statistics(t, repeated, words) == base_brute(t)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(5)
    model = line_crf.LineCrf(tuple(rng.normal(size=line_crf.FEATURES)), ((0.4, -0.3), (-0.2, 0.6)))
    for n in range(1, 8):
        lines = [list(rng.integers(0, line_crf.FEATURES, 9)) for _ in range(n)]
        paths = [[int(c) for c in f"{i:0{n}b}"] for i in range(2**n)]
        score = lambda p: sum(sum(model.emit[k] for k in f) * y for f, y in zip(lines, p)) + sum(model.move[a][b] for a, b in zip(p, p[1:]))
        assert score(line_crf.viterbi(model, lines)) == pytest.approx(max(map(score, paths)))
    assert line_crf.viterbi(model, []) == []


def test_line_verdicts_of_the_table(spark, sf):
    """Every document's verdict, from the best of all label sequences found by plain forward maxima over labels of each line."""
    from stratamesh.llm import queries

    d = table(spark, sf, "documents")
    model = line_crf.fit(d, table(spark, sf, "labels"))
    got = {r["doc_id"]: r for r in queries.op6_line_crf(spark, sf).collect()}
    for r in d.collect():
        text = r["text"] or ""
        base = base_brute(text) if len(text) < 3000 else None
        lines, _, words = line_crf.read_lines(text)
        paths = {0: (0.0, []), 1: (model.start, [])}
        for i, (_, feats) in enumerate(lines):
            e = (0.0, sum(model.emit[k] for k in feats))
            if i:
                paths = {y: max(((paths[x][0] + model.move[x][y] + e[y], [*paths[x][1], y]) for x in (0, 1)), key=lambda p: p[0]) for y in (0, 1)}
            else:
                paths = {y: (paths[y][0] + e[y], [y]) for y in (0, 1)}
        labels = max(paths.values(), key=lambda p: p[0])[1] if lines else []
        total = sum(n for n, _ in lines)
        share = sum(n for (n, _), y in zip(lines, labels) if not y) / total if total else 0.0
        own = got[r["doc_id"]]
        if base:
            assert (own["n_words"], own["word_chars"], own["n_symbols"], own["n_dup_lines"], own["n_repeat_words"]) == base
            assert own["base_failed"] == (base[0] < 50 or 100 * base[4] > 50 * base[0])
        assert own["content_share"] == pytest.approx(share) and own["kept"] == (not own["base_failed"] and share >= 0.5)


def test_line_crf(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeioubcdfglmnprst") for _ in range(rng.randint(2, 9)))
    good = "\n".join("The fox " + " ".join(word() for _ in range(14)) + "." for _ in range(9))
    bad = "\n".join(" | ".join(f"{word().upper()}!!" for _ in range(9)) + f" $$$ BUY {i} ###" for i in range(9))
    model = line_crf.train([(good.replace("fox", f"fox{i}"), 1) for i in range(30)] + [(bad.replace("BUY", f"BUY{i}"), 0) for i in range(30)])
    rows = [*ODD, (40, good), (41, bad), (42, good + "\n" + bad.split("\n")[0]), (43, bad + "\n" + good.split("\n")[0])]
    got = {r["doc_id"]: r for r in line_crf.mark(docs(spark, rows).withColumn("kept", F.lit("clash")), model).collect()}
    assert [got[k]["kept"] for k in (40, 41, 42, 43)] == [True, False, True, False]
    assert got[42]["n_boilerplate_lines"] == 1 and got[6]["base_failed"] and not any(got[k]["kept"] for k in (1, 2, 3, 4))
    assert got[40]["score"] == "x" and line_crf.mark(empty(spark), model).count() == 0
    assert line_crf.train([]).move == ((0.0, 0.0), (0.0, 0.0))


# --- secrets


def spans_brute(t):
    out = []
    for k, (name, pattern) in enumerate((("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+"))):
        for m in re.finditer(pattern, t):
            if len(m[2] if name == "assign" else m[0]) >= (6, 20, 24)[k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_secrets(spark):
    model = secrets.fit(docs(spark))
    rng = random.Random(6)
    parts = ["token = ", "Secret:'", "API_KEY=", "password:", "AKIA", "ABCDEFGH12345678", "deadbeef" * 3, "0123456789abcdef01234567", " ", "\n", "x", "é😀", "=", "short", "tokeN: token: abcdef", "ſecret=abcdefg", "to\u212aen=abcdefg"]
    rows = [*ODD, *[(100 + i, "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))) for i in range(300)]]
    got = secrets.scan(docs(spark, rows).withColumn("secrets", F.lit(0)), model)
    for r in got.collect():
        assert [(s["start"], s["kind"], s["end"]) for s in r["secrets"] if s["kind"] < 3] == spans_brute(r["text"] or ""), r["text"]
        assert all((r["text"][s["start"] : s["end"]]) == s["hit"] for s in r["secrets"])
    clean = {r["doc_id"]: r["text"] for r in secrets.redacted(got).collect()}
    assert clean[1] is None and clean[2] == "" and not any(spans_brute(t or "") for t in clean.values() if t and "[SECRET]" not in t)
    assert secrets.scan(empty(spark), model).count() == 0


def test_markov(spark):
    model = secrets.fit(docs(spark, [(i, "ordinary words of a corpus are written here and elsewhere") for i in range(20)]))
    random_ones = secrets.random_samples(300, seed=99)
    plain = secrets.ordinary_samples(300, seed=98)
    df = spark.createDataFrame([(s, 1) for s in random_ones] + [(s, 0) for s in plain if len(s) >= 16], "s string, y int").withColumn("r", secrets.log_ratio(F.col("s"), model))
    assert df.where("y = 1").agg(F.avg((F.col("r") > 0).cast("int"))).first()[0] > 0.97
    assert df.where("y = 0").agg(F.avg((F.col("r") <= 0).cast("int"))).first()[0] > 0.97
    found = secrets.scan(docs(spark, [(1, "see qX7vRt2LpZ9wKd4HsB1nYc8F here, get_user_account_number_2 there, 1234567890123456 too")]), model).first()["secrets"]
    assert [(s["kind"], s["hit"]) for s in found] == [(3, "qX7vRt2LpZ9wKd4HsB1nYc8F")]


def test_planted_keys_of_every_alphabet_are_found_through_scan(spark, sf):
    """Recall of 0.95 and more for every alphabet, by spans of kind markov alone; of ordinary identifiers, at most one in a hundred is named."""
    model, rng = secrets.fit(table(spark, sf, "documents")), random.Random(23)
    kinds = {k: [s for s in secrets.random_samples(80, 50 + i, (k,)) if len(s) >= 20] for i, k in enumerate((*secrets.KEYS, *secrets.LETTERS))}
    plain = [s for s in secrets.ordinary_samples(900, 61) if len(s) >= 16]
    rows, planted = [], {}
    for s, kind in [(s, k) for k, own in kinds.items() for s in own] + [(s, None) for s in plain]:
        before = " ".join(rng.choice(("the", "of", "value", "is", "here")) for _ in range(rng.randint(1, 6))) + " "
        planted[len(rows)] = (kind, len(before), len(before) + len(s))
        rows.append((len(rows), f"{before}{s} and on it goes."))
    got = {r["doc_id"]: {(s["start"], s["end"]) for s in r["secrets"]} for r in secrets.scan(docs(spark, rows), model).collect()}
    for kind in kinds:
        own = [i for i, (k, _, _) in planted.items() if k == kind]
        assert sum(planted[i][1:] in got[i] for i in own) >= 0.95 * len(own), kind
    assert sum(bool(got[i]) for i, (k, _, _) in planted.items() if k is None) <= 0.01 * len(plain)
    value = secrets.scan(docs(spark, [(1, "api_key = 'qX7vRt2LpZ9wKd4HsB1nYc8F'")]), model).first()["secrets"]
    assert [(s["kind"], s["start"], s["end"]) for s in value] == [(0, 0, 35), (3, 11, 35)]


def test_log_ratio_equals_plain_sums(spark):
    model = secrets.fit(docs(spark))
    rows = [*secrets.random_samples(40, 71), *secrets.ordinary_samples(40, 72), "a", "é=x"]
    for r in spark.createDataFrame([(s,) for s in rows], "s string").withColumn("r", secrets.log_ratio(F.col("s"), model)).collect():
        assert r["r"] == pytest.approx(secrets.ratio_of(r["s"], model))


def test_clashing_names_stay(spark):
    """Names that operators use inside are left alone."""
    names = ["t", "base", "token", "assign", "hex", "found", "low", "fetched", "hit", "name", "best", "sub", "place", "n", "start", "_row", "_assign", "_hex", "_low", "_best", "_sub"]
    df = docs(spark).withColumns({c: F.lit(c) for c in names}).withColumn("url", F.lit("http://www.spam-farm.org/x"))
    for out in (
        secrets.scan(df, secrets.MarkovRatio((0.0,) * 67, (0.0,) * 67 * 67)), urlfilter.filter_urls(df), urlfilter.filter_urls_by_table(df, spark.createDataFrame([("||spam-farm.",)], "rule string")),
        sharding.rendezvous(df, "doc_id", 4, grown="g"), sharding.with_slots(sharding.rendezvous(df, "doc_id", 4, weights=[1, 2, 3, 4]), "doc_id", "shard", ["doc_id", "text"]),
    ):
        got = out.collect()
        assert len(got) == len(ODD) and all(r[c] == c for r in got for c in names)


def test_markov_counts_every_document(spark):
    rows = docs(spark, [*ODD, *[(i, "plain words") for i in range(100, 1100)], *[(i, "qqxx zzkk1 x_qqxx") for i in range(2000, 2003)]])
    want = {}
    for r in rows.collect():
        for w in re.findall(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{4,}(?![A-Za-z0-9+/_=-])", r["text"] or ""):
            for a, b in zip(w, w[1:]):
                want[a + b] = want.get(a + b, 0) + 1
    assert want["qq"] == 3 and secrets.letter_pairs(rows) == want
    assert secrets.fit(rows) == secrets.fit(rows.repartition(3)) and len(secrets.fit(empty(spark)).start) == len(secrets.ALPHABET) + 1


def test_markov_letters_alone(spark):
    model = secrets.fit(docs(spark, [(i, "ordinary words of a corpus are written here and elsewhere") for i in range(20)]))
    rng = random.Random(12)
    lower, upper = secrets.ALPHABET[:26], secrets.ALPHABET[26:52]
    kinds = (lower, upper, lower + upper, lower + upper + "-_")
    keys = [(i, f"see {''.join(rng.choice(kinds[i % 4]) for _ in range(rng.randint(20, 48)))} here") for i in range(400)]
    words = [s for s in secrets.ordinary_samples(400, seed=97) if len(s) >= 16 and not re.search("[0-9]", s)]
    words += ["-" * 40, "=" * 16, "+------+--------+", "________________Name", "----------------Name----------Value------", "//" * 20]
    rows = docs(spark, keys + [(1000 + i, f"see {w} here") for i, w in enumerate(words)])
    got = {r["doc_id"]: [(s["kind"], s["start"]) for s in r["secrets"]] for r in secrets.scan(rows, model).collect()}
    for k in range(4):
        assert sum(got[i] == [(3, 4)] for i in range(k, 400, 4)) >= 97
    assert sum(bool(v) for i, v in got.items() if i >= 1000) == 0
    one = secrets.scan(docs(spark, [(1, "a kqzvXwPbTjRmNcYdLfGhQsVt b")]), model).first()["secrets"]
    assert [(s["kind"], s["hit"]) for s in one] == [(3, "kqzvXwPbTjRmNcYdLfGhQsVt")]


# --- near-duplicates


def groups_brute(rows, percent=75):
    sets = []
    for k, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {b" ".join(w)} if w else set())
    parent = {k: k for k, _ in rows if k is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b = rows[j][0]
            if a is not None and b is not None and sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {k: find(k) for k in parent}, [(k, len(s)) for (k, _), s in zip(rows, sets)]


def test_near_duplicates(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(500)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = list(ODD)
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(5, 90))]
        for _ in range(rng.randint(1, 9)):
            own = [rng.choice(vocabulary) if rng.random() < rng.choice((0, 0.01, 0.04)) else w for w in base]
            rows.append((1000 + len(rows), " ".join(own).upper() if rng.random() < 0.3 else "\t".join(own)))
    for _ in range(90):  # texts around one passage, alike and not alike enough
        rows.append((1000 + len(rows), " ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randint(0, 26))])))
    rows += [(5000, rows[20][1]), (5000, rows[-1][1]), (1003, "Twice The Same Row")]
    got = near_dedup.near_duplicates(docs(spark, rows)).collect()
    want, sizes = groups_brute(rows)
    assert len(got) == len(rows)
    assert sorted(map(str, ((r["doc_id"], r["n_shingles"]) for r in got))) == sorted(map(str, sizes))
    for r in got:
        assert r["component_id"] == want.get(r["doc_id"]) and r["kept"] == (r["doc_id"] is None or r["component_id"] == r["doc_id"])
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_of_a_table(spark, monkeypatch):
    """Components of a whole table equal those of all pairs, with every open bucket taken for a large one."""
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 0)
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()]
    want, _ = groups_brute(rows)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs(spark, rows)).collect()}
    assert got == want and len(set(want.values())) < len(want)


def test_rare_shingles_find_all_pairs(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = [(i, " ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))])) for i in range(120)]
    members = written(spark.createDataFrame([(k, k) for k, _ in rows], "id long, comp long"), "members")
    pairs = {(r["a"], r["b"]) for r in near_dedup._by_rare_shingles(members, near_dedup.signatures(docs(spark, rows), "doc_id", "text", 5), docs(spark, rows), "doc_id", "text", 5, 0.75).collect()}
    sets = {k: set(near_dedup.shingles(t).tolist()) for k, t in rows}
    true = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b])}
    assert true and true <= pairs and len(pairs) < 120 * 119 / 2


def test_bbit_estimate(spark):
    rng = np.random.default_rng(9)
    rows = []
    for share in (0.5, 0.75, 0.95):
        for i in range(40):
            both = rng.integers(1, 1 << 62, int(600 * share), dtype=np.uint64)
            n = (600 - len(both)) // 2
            a, b = (np.unique(np.concatenate([both, rng.integers(1, 1 << 62, n, dtype=np.uint64)])) for _ in "ab")
            j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            rows.append((j, *(near_dedup.packed(near_dedup.minima(x)).tolist() for x in (a, b))))
    df = spark.createDataFrame(rows, "j double, a array<long>, b array<long>").withColumn("e", near_dedup.estimate(F.col("a"), F.col("b")))
    off = df.agg(F.avg(F.col("e") - F.col("j")), F.max(F.abs(F.col("e") - F.col("j")))).first()
    assert abs(off[0]) < 0.02 and off[1] < near_dedup.SLACK


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (5, 5), (200, 199), (None, 3), (101, 100)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 103: 100, 200: 199}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- url filters


def test_url_filters(spark):
    rules = (*urlfilter.DEFAULT_RULES, "*plain*", "|https://only.", "end.html|")
    urls = [None, "", "no scheme", "HTTP://SPAM-FARM.example.org/En/1", "http://a.spam-farm.x/en/abuse", "http://spam-farm.example.org/en/abuse", "http://notspam-farm.x/", "http://x.y/?clickid=1&clickid=2", "http://x/completelyplainly", "https://only.x/", "http://q/https://only.x", "http://x/end.html", "http://x/end.html\n", "http://tracker.a/b/pixel", "http://tracker.a/b/pixels", "http://x\n/wp-login.php", "http://x/wp-login.php", "http://x/wp-login.php"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("matched", F.lit(0))
    got = {r["page_id"]: r for r in urlfilter.filter_urls(df, rules=rules).collect()}
    low = lambda u: (u or "").translate(str.maketrans(urlfilter.UPPER, urlfilter.LOWER))
    for i, u in enumerate(urls):
        want = [r for r in rules if re.search(urlfilter.to_regex(r).replace(r"\z", r"\Z"), low(u))]
        assert got[i]["matched"] == want, u
        assert got[i]["pattern_verdict"] == ("block" if any(not r.startswith("@@") for r in want) and not any(r.startswith("@@") for r in want) else "allow")
        assert got[i]["n_tried"] <= 6
    index, rest = urlfilter.rule_index(df.union(df.limit(0)), "url", ["||spam-farm.", "*plain*", "/no-example.", "||example.spam^"])
    assert rest == [1] and index == {"spam": [0], "no": [2], "example": [3]}
    assert urlfilter.filter_urls(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        urlfilter.filter_urls(df, rules=["x"] * (urlfilter.MAX_RULES + 1))


def test_url_filters_by_table(spark):
    rules = [*urlfilter.DEFAULT_RULES, "*plain*", "|https://only.", "end.html|", *(f"||host{i}.example." for i in range(urlfilter.MAX_RULES))]
    urls = [None, "", "HTTP://SPAM-FARM.example.org/En/1", "http://spam-farm.example.org/en/abuse", "http://x/completelyplainly", "https://only.x/", "http://x/wp-login.php", "http://x/wp-login.php", "http://a.host7.example.com/", "http://host19999.example.org/end.html", "http://host20000.example.org/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("matched", F.lit(0))
    table = spark.createDataFrame([(r,) for r in [*rules, None, rules[0]]], "rule string")
    got = {r["page_id"]: r for r in urlfilter.filter_urls_by_table(df, table).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        low = (u or "").translate(str.maketrans(urlfilter.UPPER, urlfilter.LOWER))
        want = sorted(r for r in rules if re.search(urlfilter.to_regex(r).replace(r"\z", r"\Z"), low))
        assert got[i]["matched"] == want and got[i]["n_tried"] <= 6, u
        assert got[i]["pattern_verdict"] == ("block" if any(not r.startswith("@@") for r in want) and not any(r.startswith("@@") for r in want) else "allow")
    few = table.limit(0)
    assert {(r["n_tried"], r["pattern_verdict"]) for r in urlfilter.filter_urls_by_table(df, few).collect()} == {(0, "allow")}


def test_url_parts(spark):
    urls = [None, "x", "a://B.Com/en/7?x#y", "://", "q?z=http://h.com/en/", "http://net", "http://EXAMPLE.NET/de/8/1", "http://myexample.com/en/7", "http://É.org/es/", "ftp://a.org/es/#"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    host, path = urlfilter.split_url(F.col("url"))
    df = df.select(host.alias("host"), path.alias("path"))
    got = [tuple(r) for r in df.select("host", "path", urlfilter.base_rule(F.col("host"), F.col("path"))[0].alias("r")).collect()]
    assert got == [("", "", None), ("", "", None), ("b.com", "/en/7", "com/en/"), ("", "", None), ("h.com", "/en/", "com/en/"), ("net", "", None), ("example.net", "/de/8/1", "example.net/de/8"), ("myexample.com", "/en/7", "com/en/"), ("É.org", "/es/", "org/es/"), ("a.org", "/es/", "org/es/")]


# --- quality classifier


def test_rule_ensemble_on_known_rules():
    rng = np.random.default_rng(10)
    x = rng.uniform(size=(3000, 4))
    y = ((x[:, 0] > 0.6) & (x[:, 1] <= 0.4) | (x[:, 2] > 0.9)).astype(int)
    model = quality_model.fit_rules(list("abcd"), x, y)
    z = np.full(3000, model.bias)
    for r in model.rules:
        hit = np.ones(3000, bool)
        for name, over, bound in r.tests:
            v = x[:, "abcd".index(name)]
            hit &= v > bound if over else v <= bound
        z += r.weight * hit
    assert ((z > 0) == (y == 1)).mean() > 0.95 and 0 < len(model.rules) < 150
    assert quality_model.fit_rules(["a"], np.zeros((0, 1)), np.zeros(0)).rules == ()
    assert quality_model.fit_rules(["a"], np.ones((5, 1)), np.ones(5)).bias > 0


def test_compiled_rules_equal_numpy(spark, sf):
    """The column expression against the rules evaluated one by one on the collected statistics."""
    from stratamesh.llm.queries import held_out

    d = table(spark, sf, "documents")
    model = quality_model.fit(d, table(spark, sf, "labels").where(~held_out()))
    stats = quality_model.statistics(F.coalesce("text", F.lit("")))
    rows = d.unionByName(docs(spark).selectExpr("doc_id", "text", "'' AS lang", "'' AS source", "0L AS n_chars"))
    got = quality_model.score(rows, model).select("score", *(c.alias(k) for k, c in stats.items())).collect()
    assert model.rules
    for r in got:
        z = model.bias + sum(rule.weight for rule in model.rules if all((r[name] > bound) == over for name, over, bound in rule.tests))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-z)))


def test_scores(spark, sf):
    from stratamesh.llm.queries import held_out

    d, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality_model.fit(d, labels.where(~held_out()))
    got = quality_model.score(d, model).join(labels, "doc_id")
    right = got.where(held_out()).agg(F.avg(((F.col("score") >= 0.5) == (F.col("quality") == 1)).cast("int"))).first()[0]
    assert right >= 0.95
    odd = quality_model.score(docs(spark).withColumn("words", F.lit("clash")), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 and r["words"] == "clash" for r in odd)
    assert quality_model.score(empty(spark), model).count() == 0


def test_samples_for_training_are_bounded_whatever_is_repeated(spark, sf, monkeypatch):
    """Rows of documents and labels that stand many times: the driver gets as many rows as without, and the models are the same."""
    d, labels = table(spark, sf, "documents"), table(spark, sf, "labels").where("quality IS NOT NULL")
    again = lambda df, n: df.crossJoin(spark.range(n).select(F.col("id").alias("_copy"))).drop("_copy")
    frame, got = type(d), []
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda df: got.append(rows := collect(df)) or rows)
    crf, rules = line_crf.fit(d, labels, max_docs=20), quality_model.fit(d, labels, max_rows=20)
    once = [len(x) for x in got]
    got.clear()
    assert crf.move != ((0.0, 0.0), (0.0, 0.0)) and max(once) <= 20
    assert line_crf.fit(again(d, 30), again(labels, 30), max_docs=20) == crf
    assert quality_model.fit(again(d, 30), again(labels, 30), max_rows=20) == rules
    assert [len(x) for x in got] == once


def test_statistics_are_never_null(spark):
    stats = quality_model.statistics(F.coalesce("text", F.lit("")))
    rows = docs(spark).select(*(c.alias(k) for k, c in stats.items())).collect()
    assert all(v is not None and v == v for r in rows for v in r)
