"""License scans: a trained paragraph classifier, with confirmation by templates.

Sparse logistic regression over word n-grams tells licence families apart and from anything else. It is trained when
it is first asked for, on the templates below with seeded variations and on ordinary sentences. Scanning is column expressions only.
"""

from __future__ import annotations

import functools
import json
import random
import re
from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamesh.llm._io import text_of

#: Short notices of public licences by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Apache Software License 2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "This project is distributed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Released under the GPL v2 or later.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Distributed under the MPL 2.0.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY-SA 3.0.",
        "Licensed under a Creative Commons Attribution-ShareAlike 3.0 License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
    ),
    "cc0": (
        "CC0 1.0 Universal. To the extent possible under law, the author has waived all copyright and related rights.",
        "This work is dedicated to the public domain.",
    ),
    "lgpl": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
    ),
    "agpl": (
        "This program is licensed under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Affero General Public License, version 3.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Released under the ISC License.",
    ),
    "epl": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "Licensed under the Eclipse Public License, version 2.0.",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Released under the Unlicense.",
    ),
    "zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software",
        "Released under the zlib License.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright 2020 Example Corporation. All rights reserved.",
        "No part of this publication may be reproduced without prior written permission of the publisher.",
    ),
}
FAMILIES = tuple(TEMPLATES)
#: Short names and SPDX identifiers of the families, put into every one of FRAMES.
NAMES: dict[str, tuple[str, ...]] = {
    "apache": ("Apache-2.0", "Apache 2.0"),
    "mit": ("MIT", "MIT License"),
    "bsd": ("BSD-2-Clause", "BSD-3-Clause", "BSD"),
    "gpl": ("GPLv2", "GPLv3", "GPL-2.0-only", "GPL-3.0-or-later", "GPL v3", "GNU GPL v2", "GPL"),
    "lgpl": ("LGPLv2", "LGPLv3", "LGPL-2.1-only", "LGPL-3.0-or-later", "LGPL v3", "GNU LGPL v2.1", "LGPL"),
    "agpl": ("AGPLv3", "AGPL-3.0-only", "AGPL-3.0-or-later", "AGPL v3", "GNU AGPL v3", "AGPL"),
    "mpl": ("MPL-2.0", "MPLv2", "MPL"),
    "cc-by": ("CC-BY-4.0", "CC-BY-SA-4.0"),
    "cc-by-nc": ("CC-BY-NC-4.0", "CC-BY-NC-SA-4.0"),
    "cc0": ("CC0-1.0", "CC0"),
    "isc": ("ISC", "ISC License"),
    "epl": ("EPL-2.0", "EPL-1.0", "EPL"),
    "unlicense": ("Unlicense",),
    "zlib": ("Zlib", "zlib License"),
}
#: Licences of no family here. Half of them are learned as unknown, half tell how sure the classifier may be.
OTHER_LICENCES = (
    "Open Software License 3.0", "Artistic License 2.0", "Boost Software License", "Academic Free License", "European Union Public Licence", "Common Development and Distribution License",
    "Microsoft Public License", "SIL Open Font License", "PostgreSQL License", "Python Software Foundation License", "University of Illinois Open Source License", "Open Data Commons License",
    "Server Side Public License", "Elastic License 2.0", "Business Source License 1.1", "Commons Clause License",
)
FRAMES = ("{}", "Released under {}", "Released under the {}", "Licensed under the {}", "Distributed under the {}", "License: {}", "SPDX-License-Identifier: {}")
#: Ordinary sentences, some of them with words of licences; `mit` is also the German word for with.
ORDINARY = (
    "She renewed her driving license at the office in town last week.",
    "The pilot lost his licence after the incident and had to train again.",
    "A poetic license lets the author change the order of events.",
    "Human rights were discussed at the general assembly.",
    "The table was reserved for six people under the name of the host.",
    "He asked for permission to leave the room early.",
    "The committee granted a delay until the end of the month.",
    "The commercial success of the film surprised its makers.",
    "A creative mind finds patterns in the public domain of ideas.",
    "The copyright debate in parliament went on through the night.",
    "The apache helicopter landed behind the hangar.",
    "Members of the house of commons voted on the bill.",
    "Smoking is not permitted in the building.",
    "The modification of the engine made it louder.",
    "All seats are taken and the rights to the song were sold.",
    "The version of the story that he told was not the same.",
    "The general public is invited to the opening of the museum.",
    "We use this file to keep the source of the data.",
    "The work was released in the spring and read by many people.",
    "It is free of charge for any person under the age of ten.",
    "Er kam mit dem Zug und ging mit den Kindern nach Hause.",
    "Mit der Zeit wurde es besser, und am Ende kam sie auch mit.",
    "Das Haus mit einem Garten und ein Mann mit Hut sind mit im Bild.",
    "She studied physics at MIT and works in Boston now.",
    "The EPL season starts in August and the EPL clubs are ready.",
    "The eclipse was seen by the public in the north.",
    "The letter was released under pressure and distributed under the door.",
    "The identifier of the item is printed on the label.",
    "Licensed doctors work under the terms of the state.",
    "The software was provided by the authors of the program, and we use it without any fee.",
    "No one may enter without a word to the owner, and all bags must be shown with the card.",
    "It shall be held in the great hall, or in the open if it can be done without rain.",
    "More can be said of this, and even the following pages see only a part of it.",
    "To the north of the town it will be cold, and no part of the road is free from snow.",
    "She put a copy of the letter into the box with the other copies and a written notice on it.",
    "The above list of conditions was included in the report, subject to a later notice.",
    "You can use this room or that one; it is all the same to me, and more may come.",
    "A library is a place to use books, and this library is open to the public all day.",
    "Whatever is held without care will be lost, or sold, or put to other use by the next event.",
    "The following persons are to deal with the files and the source of the noise.",
    "Version 3 of the plan has 2 parts, or 4 at a later time, and 0 or 1 only in the end.",
)


@dataclass(frozen=True)
class LicenceModel:
    #: n-gram -> weight for each class: FAMILIES, then unknown. Only n-grams with a weight.
    weights: dict[str, tuple[float, ...]]
    bias: tuple[float, ...]
    temperature: float


ALONE = "="
#: Maps that the weights are dealt over.
BUCKETS = 128
#: Characters of the shortest and longest line that may have been wrapped, and the line breaks that end a paragraph.
WRAPPED, WIDEST = 40, 160
#: The line break comes first, so that nothing is looked at elsewhere.
BREAK = r"\n(?:" + "|".join((
    rf"(?<![^\n]{{{WRAPPED}}}\n)", rf"(?<=[^\n]{{{WIDEST + 1}}}\n)", r"""(?<=[.!?:]["')\]]{0,2}[ \t\r]{0,3}\n)""", r"(?=[ \t\r]*(?:\n|\z))")) + ")"


def words_of(text: str) -> list[str]:
    """The words, and ALONE behind a single one in capitals: so stands a licence's short name, but not the German word mit."""
    words = [w for w in re.split("[^a-z0-9]+", text.lower()) if w]
    return words + [ALONE] * (len(words) == 1 and text == text.upper())


def grams_of(words: list[str]) -> set[str]:
    """Words and pairs of neighbours."""
    return {*words, *map(" ".join, zip(words, words[1:], strict=False))}


def short_forms(family: str) -> list[str]:
    return [f.format(n) for n in NAMES.get(family, ()) for f in FRAMES]


def labelled_samples(copies: int = 30, seed: int = 5) -> list[tuple[list[str], int, bool]]:
    """(words, class, held out): templates whole, with words left out, and inside ordinary words; short forms; ordinary sentences likewise and their words by chance; licences of no family.

    Every fourth template, short form and sentence is held out with all its variations, and every other one of OTHER_LICENCES.
    """
    rng, out = random.Random(seed), []
    filler = words_of(" ".join(ORDINARY))
    names = set(words_of(" ".join(n for own in NAMES.values() for n in own)))
    plain = [w for w in filler if w not in names]
    around = lambda own: rng.sample(filler, rng.randint(1, 12)) + own + rng.sample(filler, rng.randint(1, 12))
    for k, texts in enumerate([*TEMPLATES.values(), ORDINARY]):
        unknown = k == len(FAMILIES)
        for n, t in enumerate(texts):
            words, held = words_of(t), n % 4 == 3
            for i in range(copies):
                own = [w for w in words if i == 0 or rng.random() > 0.1 * (len(words) > 4)]
                out.append((around(own) if i % 3 == 2 else own, k, held))
            if unknown:
                out += [([rng.choice(filler) for _ in range(rng.randint(3, 30))], k, held) for _ in range(copies)]
                out += [([rng.choice(plain), rng.choice((rng.choice(plain), ALONE))], k, held) for _ in range(copies)]
        for n, t in enumerate(() if unknown else short_forms(FAMILIES[k])):
            own = words_of(t)
            for i in range(copies if ALONE in own else copies // 3):
                out.append((around(own) if i % 3 == 2 and len(own) > 2 else own, k, n % 4 == 3))
    for n, name in enumerate(OTHER_LICENCES):
        for f in FRAMES[1:]:
            own = words_of(f.format(name))
            out.append((own, len(FAMILIES), n % 2 == 1))
    return out


def _soft(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _fitted(samples: list[tuple[list[str], int, bool]], penalty: float, rounds: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(n-grams, weights, bias) of a multinomial logistic regression with an L1 penalty."""
    sets = [grams_of(w) for w, _, _ in samples]
    seen = Counter(g for own in sets for g in own)
    # the loss's slope along a gram of n samples is n / len(samples) at most: under the penalty, its weight is surely zero
    grams = sorted(g for g, n in seen.items() if n > penalty * len(samples))
    x, y = _matrix(sets, grams), np.zeros((len(samples), len(FAMILIES) + 1), np.float32)
    y[np.arange(len(samples)), [k for _, k, _ in samples]] = 1
    w, b = np.zeros((len(grams), y.shape[1]), np.float32), np.log(np.maximum(y.mean(0), 1e-6))
    z, zb, t = w.copy(), b.copy(), 1.0
    v = np.ones(len(grams), np.float32)
    for _ in range(50):  # the largest singular value, from below
        v = x.T @ (x @ (v / np.linalg.norm(v)))
    rate = float(2.0 / (1 + 1.05 * np.linalg.norm(v) / len(x)))
    for _ in range(rounds):
        off = (_soft(x @ z + zb) - y) / len(x)
        new = z - rate * (x.T @ off)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        nb = zb - rate * off.sum(0)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, zb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = new, nb, t2
    return grams, w, b


def _matrix(sets: list[set[str]], grams: list[str]) -> np.ndarray:
    at = {g: i for i, g in enumerate(grams)}
    x = np.zeros((len(sets), len(grams)), np.float32)
    for i, own in enumerate(sets):
        x[i, [at[g] for g in own if g in at]] = 1
    return x


@functools.cache
def train(penalty: float = 0.0005, rounds: int = 160) -> LicenceModel:
    """The classifier of all samples, as sure as one that never saw the held-out texts may be: its temperature is the likeliest for those, by the model without them."""
    samples = labelled_samples()
    grams, w, b = _fitted([s for s in samples if not s[2]], penalty, rounds)
    held = [s for s in samples if s[2]]
    logits, classes = _matrix([grams_of(s[0]) for s in held], grams) @ w + b, [s[1] for s in held]
    loss = lambda heat: -np.log(np.maximum(_soft(logits / heat)[np.arange(len(held)), classes], 1e-12)).mean()
    heat = min(np.linspace(0.3, 3, 55), key=loss)
    grams, w, b = _fitted(samples, penalty, rounds)
    kept = {g: tuple(map(float, w[i].round(6))) for i, g in enumerate(grams) if np.abs(w[i]).max() > 1e-6}
    return LicenceModel(kept, tuple(map(float, b.round(6))), float(heat))


def telling(model: LicenceModel) -> list[str]:
    """Grams of which every paragraph that can be listed has one: all the others for a family taken together weigh less than unknown's lead.

    Words of ordinary sentences are left out first, then the lightest grams. Nothing is told by grams if unknown doesn't lead without any.
    """
    lead = model.bias[-1] - np.array(model.bias[:-1])
    if lead.min() <= 0:
        return []
    gain = {g: np.maximum(np.array(w[:-1]) - w[-1], 0) for g, w in model.weights.items()}
    ordinary = words_of(" ".join(ORDINARY))
    common = {ALONE, *ordinary, *map(" ".join, zip(ordinary, ordinary[1:], strict=False))}
    total, out = np.zeros(len(lead)), []
    for g in sorted(gain, key=lambda g: (g not in common, gain[g].max(), g)):
        if (total + gain[g] < lead - 1e-6).all():
            total += gain[g]
        else:
            out.append(g)
    return out


def _tree(words: list[str]) -> str:
    """A regular expression of any of the words, by common beginnings; a space is anything between two words."""
    if words == [""]:
        return ""
    heads: dict[str, list[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    body = "|".join(("[^a-z0-9]+" if c == " " else c) + _tree(tails) for c, tails in sorted(heads.items()))
    return f"(?:{body})" + ("?" if "" in words else "")


def prefilter(model: LicenceModel) -> str:
    """A regular expression over lower-cased text that fits wherever one of telling() stands."""
    grams = telling(model)
    alone, within = [g.rstrip(" =") for g in grams if g.endswith(ALONE)], [g for g in grams if not g.endswith(ALONE)]
    either = [rf"(?<![a-z0-9]){_tree(within)}(?![a-z0-9])"] if within else []
    return "|".join(either + ([rf"(?md)^[^a-z0-9\n]*{_tree(alone) if all(alone) else '[a-z0-9]+'}[^a-z0-9\n]*$"] if alone else []))


def _constant(value, ddl: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), ddl)


def scan(docs: DataFrame, model: LicenceModel | None = None, text: str = "text", out: str = "licences", least: float = 0.5, overlap: float = 0.5) -> DataFrame:
    """Adds `out`, an array of (paragraph, family, probability, confirmed) of the text's licence paragraphs, in order.

    Paragraphs end at blank lines, at lines that end in a full stop, question or exclamation mark or colon, and at lines of less than WRAPPED or more than WIDEST characters;
    other lines go on in the next, as wrapped notices do. They are numbered from 0, empty ones counted. A paragraph's class is that of the
    largest calibrated probability, ties to the first family; unknown and probabilities under `least` aren't listed.
    confirmed: of one of the family's templates or short forms, at least `overlap` of the n-grams that speak for the family are in the paragraph. Null and empty
    texts have none; repeated rows have equal results; a column of the name `out` is replaced. One pass, no shuffle.
    Texts and paragraphs without any gram of telling() aren't classified, as their class is surely unknown.
    """
    model = model or train()
    t = text_of(text)
    maybe = prefilter(model)
    buckets: list[dict] = [{} for _ in range(BUCKETS)]
    for g, w in model.weights.items():
        buckets[crc32(g.encode()) % BUCKETS][g] = w
    table = _constant(buckets, "array<map<string,array<double>>>")  # a map is searched key by key, so each is kept small
    weights = lambda g: F.element_at(F.element_at(table, (F.crc32(g) % BUCKETS + 1).cast("int")), g)
    known = _constant(sorted(model.weights), "array<string>")
    bias = _constant(model.bias, "array<double>")
    speaks = lambda g, c: g in model.weights and model.weights[g][c] > model.weights[g][-1]
    own = [[sorted(g for g in grams_of(words_of(x)) if speaks(g, c)) for x in (*v, *short_forms(f))] for c, (f, v) in enumerate(TEMPLATES.items())]
    templates = _constant([[x for x in v if x] for v in own], "array<array<array<string>>>")
    families = _constant(list(FAMILIES), "array<string>")
    k = len(FAMILIES) + 1

    def words(p: Column) -> Column:
        own = F.filter(F.split(F.lower(p), "[^a-z0-9]+"), lambda w: w != "")
        return F.when((F.size(own) == 1) & (p == F.upper(p)), F.concat(own, F.array(F.lit(ALONE)))).otherwise(own)

    def grams(w: Column) -> Column:
        pairs = F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
        return F.array_intersect(F.concat(w, F.filter(pairs, lambda g: g.isNotNull())), known)

    def soft(g: Column) -> Column:
        logits = F.aggregate(g, bias, lambda s, x: F.zip_with(s, weights(x), lambda a, b: a + b), lambda s: F.transform(s, lambda v: F.exp(v / model.temperature)))
        return logits

    def judged(p: Column) -> Column:
        first = F.transform(F.array(p["t"]), lambda x: grams(words(x)))
        second = F.transform(first, lambda g: F.struct(g.alias("g"), soft(g).alias("e")))
        third = F.transform(second, lambda s: F.struct(s["g"].alias("g"), F.array_position(s["e"], F.array_max(s["e"])).cast("int").alias("c"), (F.array_max(s["e"]) / F.aggregate(s["e"], F.lit(0.0), lambda a, v: a + v)).alias("p")))
        fits = lambda s: F.exists(F.element_at(templates, F.least(s["c"], F.lit(k - 1))), lambda own: F.size(F.array_intersect(own, s["g"])) >= F.lit(overlap) * F.size(own))
        listed = lambda s: (s["c"] < k) & (s["p"] >= least)
        done = F.transform(third, lambda s: F.when(listed(s), F.struct(p["i"].alias("paragraph"), F.element_at(families, F.least(s["c"], F.lit(k - 1))).alias("family"), s["p"].alias("probability"), fits(s).alias("confirmed"))))
        return F.element_at(done, 1)

    cut = F.transform(F.split(t, BREAK), lambda p, i: F.struct(i.alias("i"), p.alias("t")))
    some = F.filter(cut, lambda p: F.lower(p["t"]).rlike(maybe))
    found = F.filter(F.transform(some, judged), lambda r: r.isNotNull())
    return docs.withColumn(out, F.when(F.lower(t).rlike(maybe), found).otherwise(F.array().cast("array<struct<paragraph:int,family:string,probability:double,confirmed:boolean>>")))


def classify(text: str, model: LicenceModel | None = None) -> tuple[str | None, float]:
    """(family or None, probability) of one paragraph, off Spark."""
    model = model or train()
    z = np.array(model.bias) + sum((np.array(model.weights[g]) for g in sorted(grams_of(words_of(text))) if g in model.weights), np.zeros(len(FAMILIES) + 1))
    e = np.exp(z / model.temperature)
    c = int(e.argmax())
    return (FAMILIES[c] if c < len(FAMILIES) else None), float(e[c] / e.sum())
