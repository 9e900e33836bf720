"""License scans: a paragraph classifier, confirmed by template comparison.

Logistic regression over word n-grams of a paragraph tells license families and an unknown class. It is trained on the
driver from the notices below, changed at random in fixed ways, and from ordinary sentences, some of which use the
words of notices; its temperature is calibrated on further changed copies. A family predicted for a paragraph counts
as confirmed if one of the family's notices is mostly contained in it. Each line is a paragraph, and so are
neighbouring lines that hold a wrapped notice together, with or without comment markers, up to a blank one. Every word
of every paragraph is looked up; one without two neighbouring words of the model's bigrams has no notice in it, is
unknown by the model's bias, and needs no further work.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import ship

#: What notices of each license family say. A notice counts as present if most of its words follow each other in a paragraph.
NOTICES = {
    "Apache-2.0": [
        "under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "the Apache 2.0 license",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "under the MIT License",
        "the terms of the MIT license",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "under the 3-clause BSD license",
        "the BSD 2-Clause License",
        "governed by a BSD-style license that can be found in the LICENSE file",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "GPL": [
        "under the GNU General Public License, version 3",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "under the GNU GPL version 2 or later",
        "the terms of the GPL v3",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "under the GNU Lesser General Public License, version 2.1",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "the terms of the LGPL v3",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "MPL-2.0": [
        "subject to the terms of the Mozilla Public License, v. 2.0",
        "under the Mozilla Public License 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY": [
        "under CC BY 4.0",
        "under a Creative Commons Attribution 4.0 International License",
    ],
    "CC-BY-SA": [
        "under CC BY-SA 4.0",
        "under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ],
    "CC-BY-NC": [
        "under CC BY-NC 4.0",
        "under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright to this work under CC0 1.0",
        "into the public domain under the CC0 license",
        "the CC0 1.0 Universal public domain dedication",
    ],
}
#: What stands before a notice in changed copies.
OPENINGS = ("This project is released", "This work is licensed", "This file is distributed", "Licensed", "Released", "The code is available", "This document is published", "")
#: Sentences that are no license notice, many with words of some.
OTHERS = [
    "He lost his driving license on the way to the public library.",
    "The restaurant is licensed to sell wine and beer until midnight.",
    "All rights reserved. Copyright 2020 by the authors.",
    "You need permission from the owner to copy this file.",
    "The Apache helicopter landed near the village under the hill.",
    "The gnu is a large animal of the open plains.",
    "The warranty covers parts for two years of use.",
    "Redistribution of income was debated in parliament and in source documents.",
    "She asked for permission to use the source of the river.",
    "Creative people met on the commons every summer.",
    "Copyright law protects the work of writers and painters.",
    "A license to operate the machine is required by law.",
    "Under the terms of the agreement the software must be returned.",
    "The public domain name was registered in May.",
    "Version 2.0 of the software was released under the new name.",
    "The general public may visit the foundation free of charge.",
    "Students of MIT published the results in May.",
    "He wrote a letter to any person obtaining a ticket without restriction.",
    "The international version 4.0 was distributed to all offices.",
    "The following conditions are met by all of the files in the copy.",
    "The house is under the bridge and the terms are good.",
    "The party was sold under the old brand and the second version of it.",
]
UNKNOWN = "unknown"
GRAMS = 4
#: Least probability of a family, and least share of a notice's n-grams that a paragraph must hold to confirm it.
PROBABILITY, CONTAINED = 0.5, 0.7
COPIES = 16

_TOKEN = regex.compile(r"[\p{L}\p{N}]+(?:\.[0-9]+)*")


def tokens(paragraph: str) -> list[str]:
    return _TOKEN.findall(paragraph.lower())


def grams(words: list[str]) -> list[str]:
    """The n-grams of two to GRAMS words."""
    return [" ".join(words[i : i + n]) for n in range(2, GRAMS + 1) for i in range(len(words) - n + 1)]


def _changed(text: str, rnd: random.Random, keep: float) -> str:
    """text with some words dropped and some words before and after it."""
    filler = "the of and in it was for on by file work project this code see also note".split()
    words = [w for w in text.split() if rnd.random() < keep]
    around = lambda: [rnd.choice(filler) for _ in range(rnd.randint(0, 8) if rnd.random() < 0.5 else 0)]
    return " ".join([*around(), *words, *around()])


def _examples(copies: int, seed: int, skip: frozenset[str]) -> list[tuple[str, str]]:
    """(paragraph, family): changed copies of the notices, with and without an opening, the other sentences, and for each notice as many paragraphs of its words that do not follow each other."""
    rnd = random.Random(seed)
    out = []
    for family, texts in NOTICES.items():
        for text in texts:
            if text not in skip:
                out += [(text, family)] + [(_changed(f"{rnd.choice(OPENINGS)} {text}", rnd, 0.95), family) for _ in range(copies)]
                out += [(" ".join(rnd.sample(words, rnd.randint(1, len(words)))), UNKNOWN) for words in [tokens(text)] for _ in range(copies // 2)]
    for text in OTHERS:
        out += [(text, UNKNOWN)] + [(_changed(text, rnd, 0.95), UNKNOWN) for _ in range(copies)]
    return out


@dataclass
class Model:
    families: list[str]
    index: dict[str, int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    seconds: dict[str, frozenset[str]]

    def close(self, words: list[str]) -> bool:
        """Whether two neighbouring words are neighbours in a notice, too."""
        known = self.seconds
        return any(b in known[a] for a, b in pairwise(words) if a in known)

    def probabilities(self, words: list[str]) -> np.ndarray:
        found = sorted({self.index[g] for g in grams(words) if g in self.index})
        z = self.bias + (self.weights[found].sum(axis=0) / max(len(found), 1) ** 0.5 if found else 0.0)
        e = np.exp((z - z.max()) / self.temperature)
        return e / e.sum()


@cache
def train(skip: frozenset[str] = frozenset()) -> Model:
    """The classifier, of all notices but those to skip; the same on every call."""
    examples = _examples(COPIES, 5, skip)
    taken = [sorted(set(grams(tokens(t)))) for t, _ in examples]
    often = Counter(g for x in taken for g in x)
    vocabulary = sorted(g for g, n in often.items() if n > 1)
    index, families = {g: i for i, g in enumerate(vocabulary)}, [*NOTICES, UNKNOWN]
    model = Model(families, index, np.zeros((len(vocabulary), len(families)), dtype=np.float32), np.zeros(len(families), dtype=np.float32), 1.0, {})
    x = np.zeros((len(examples), len(vocabulary)), dtype=np.float32)
    for i, own in enumerate(taken):
        found = [index[g] for g in own if g in index]
        x[i, found] = 1 / max(len(found), 1) ** 0.5
    y = np.eye(len(families), dtype=np.float32)[[families.index(f) for _, f in examples]]
    for _ in range(200):
        z = x @ model.weights + model.bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = (p / p.sum(axis=1, keepdims=True) - y) / np.float32(len(x))
        model.weights -= np.float32(20) * (x.T @ g + np.float32(1e-5) * model.weights)
        model.bias -= 2 * g.sum(axis=0)
    near: dict[str, set[str]] = {}
    for texts in NOTICES.values():
        for words in map(tokens, texts):
            for a, b in pairwise(words):
                near.setdefault(a, set()).add(b)
    model.seconds = {a: frozenset(b) for a, b in near.items()}
    fresh = [(tokens(t), families.index(f)) for t, f in _examples(6, 6, skip)]

    def loss(temperature: float) -> float:
        model.temperature = temperature
        return -sum(np.log(model.probabilities(w)[f] + 1e-12) for w, f in fresh)

    model.temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=loss)
    return model


@cache
def _templates(family: str) -> list[frozenset[str]]:
    out = []
    for text in NOTICES[family]:
        words = tokens(text)
        out.append(frozenset(" ".join(words[i : i + 2]) for i in range(len(words) - 1)))
    return out


def contained(words: list[str], family: str) -> float:
    """Largest share of a notice's word pairs that are in the paragraph."""
    own = {" ".join(words[i : i + 2]) for i in range(len(words) - 1)}
    return max(len(t & own) / len(t) for t in _templates(family))


#: Words of the longest notice: a passage that has so many gets no further line.
LONGEST = max(len(tokens(t)) for texts in NOTICES.values() for t in texts)
#: What is written before a line of a comment in words; other markers are no tokens.
MARKERS = (["rem"], ["dnl"])


def _judged(words: list[str], model: Model) -> tuple[str, float, float] | None:
    """(family, probability, contained) of words that the model gives a family."""
    if not model.close(words):
        return None
    p = model.probabilities(words)
    best = int(p[:-1].argmax())
    if p[best] < PROBABILITY or p[best] <= p[-1]:
        return None
    return model.families[best], float(p[best]), contained(words, model.families[best])


def _passages(lines: list[tuple[list[str], float]], model: Model) -> list[tuple[int, int, str, float, float]]:
    """(first, last, family, probability, contained) of passages of several lines that confirm a family better than each of their lines.

    lines has each line's words and how far it holds a notice by itself. A passage goes over neither a line without
    words nor one that holds a whole notice. Of passages that overlap, that with the most of a notice stays, then the shortest.
    """
    near = {j for i, (words, _) in enumerate(lines) if model.close(words) for j in (i - 1, i)}
    found = []
    for first in range(len(lines)):
        words, alone = [], 0.0
        if first not in near:
            continue
        for last in range(first, len(lines)):
            own, held = lines[last]
            if not own or held == 1.0 or len(words) >= LONGEST:
                break
            words, alone = words + own, max(alone, held)
            x = _judged(words, model) if last > first else None
            if x and x[2] >= CONTAINED and x[2] > alone:
                found.append((first, last, *x))
    out, used = [], set()
    for x in sorted(found, key=lambda x: (-x[4], x[1] - x[0], x[0])):
        if used.isdisjoint(range(x[0], x[1] + 1)):
            out.append(x)
            used.update(range(x[0], x[1] + 1))
    return out


def find(text: str, model: Model) -> list[tuple[int, int, int, str, float, float]]:
    """(paragraph, start, end, family, probability, contained) of each line that has a family, and of each notice wrapped over several lines, by its first line; positions in characters.

    A line confirmed by itself that is part of a notice confirmed better is left out.
    """
    out, start, lines, places = [], 0, [], []
    for i, paragraph in enumerate(text.split("\n")):
        end = start + len(paragraph)
        words = tokens(paragraph)
        x = _judged(words, model)
        if x:
            out.append((i, start, end, *x))
        lines.append((words[1:] if words[:1] in MARKERS else words, x[2] if x and x[2] >= CONTAINED else 0.0))
        places.append((start, end))
        start = end + 1
    for first, last, *x in _passages(lines, model):
        out = [y for y in out if not (first <= y[0] <= last and y[5] >= CONTAINED)]
        out.append((first, places[first][0], places[last][1], *x))
    return sorted(out, key=lambda x: (x[0], x[2]))


SPAN = pa.struct([("paragraph", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("contained", pa.float64())])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) of every row; spans has a struct for each line that the model gives a family, and for each notice confirmed over several lines.

    Null and empty texts have none. Repeated rows are scanned each; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(train())
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in SPAN]
        for batch in batches:
            spans = [[dict(zip(names, x, strict=True)) for x in find(t.as_py(), held.value)] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(spans, pa.list_(SPAN))], names=["id", "spans"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, spans array<struct<paragraph:int,start:long,end:long,family:string,probability:double,contained:double>>")


def confirmed(spans: str = "spans"):
    return F.filter(spans, lambda s: s["contained"] >= CONTAINED)
