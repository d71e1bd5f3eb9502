"""Licence scans: a trained paragraph classifier confirmed against templates.

A paragraph is a run of lines with words.  A line goes on in the next one if both
are comments of one kind, or if it is ``WRAP`` long and ends no sentence; every
other line ends its paragraph.  The paragraph's sparse features are the word 1- to
3-grams that occur in the licence texts below.  A softmax regression over them,
trained here in numpy on variants of those texts (words dropped, swapped or added,
cut short) and on plain paragraphs, gives each licence family, ``unknown`` (other
licences) and ``none`` a probability, sharpened or softened by a temperature that
is fitted on variants left out of the training.  A paragraph that is likelier some
licence than none is ``unknown`` unless its best family is ``SURE``, and shares at
least ``CONFIRM`` of its own, or of one template's, word pairs with a template of
that family.  Each line of a paragraph is judged on its own as well: where the
paragraph is no family's, or a line names another family and does not resemble the
paragraph's, its lines count instead, so that a notice within a comment shows, and
notices that follow each other stay apart.

The plain paragraphs are those of ``PLAIN_DOCS`` documents, the first by a hash of
the id, whole texts as far as they come to ``PLAIN_BYTES``, without those that share
``CONFIRM`` of their word pairs with a template.  Every paragraph of every row is
scored; one without any feature has the score of no words at all, which is computed
once.

Null and empty texts have no paragraphs.  Ties of two families go to the first.
Repeated rows and null ids are scanned row by row.  An empty table gives no rows.
Columns besides the two named are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, identified, text_slices, within_bytes

SURE = 0.7
CONFIRM = 0.6
#: Word pairs that a paragraph counts as at least, so that a few common words confirm nothing.
LEAST_PAIRS = 6
PLAIN_DOCS, PLAIN_BYTES = 400, 8 << 20
VARIANTS, STEPS = 24, 150
#: Lengths of a line that was wrapped.
WRAP = (40, 100)
_MARK = re.compile(r"\s*(//|#|\*|/\*|;|--|%|<!--|rem\b|dnl\b)", re.I)
_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")

#: Notices by which works name their licence.
NOTICES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the MIT License - see the LICENSE file for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "Released under the terms of the GNU GPL v2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the terms of the GNU GPL v3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    ],
    "ISC": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC0": [
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ],
    "Unlicense": [
        "The Unlicense",
        "Released under the Unlicense.",
        "This is free and unencumbered software released into the public domain.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright. All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
    ],
}
#: The identifiers by which tags and metadata name a family.
IDENTIFIERS: dict[str, list[str]] = {
    "MIT": ["MIT"],
    "Apache-2.0": ["Apache-2.0", "Apache 2.0"],
    "GPL-2.0": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPLv2"],
    "GPL-3.0": ["GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "GPLv3"],
    "AGPL-3.0": ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "AGPLv3"],
    "LGPL": ["LGPL-2.1", "LGPL-2.1-or-later", "LGPL-3.0", "LGPLv3"],
    "BSD": ["BSD-2-Clause", "BSD-3-Clause"],
    "ISC": ["ISC"],
    "MPL-2.0": ["MPL-2.0"],
    "CC-BY": ["CC-BY-4.0"],
    "CC-BY-NC": ["CC-BY-NC-4.0"],
    "CC-BY-SA": ["CC-BY-SA-4.0"],
    "CC0": ["CC0-1.0"],
    "Unlicense": ["Unlicense"],
    "proprietary": ["LicenseRef-Proprietary"],
}
#: How licences outside the families above speak.
OTHERS = [
    "Licensed under the Example Public License.",
    "Licensed under the Common Development and Distribution License, version 1.0.",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "This package may be redistributed under the terms of the Artistic License 2.0.",
    "Distributed under the terms of the Academic Free License version 3.0.",
    "Licensed under the Microsoft Public License.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions.",
    "This software is released under the terms of the following license.",
    "You may use, copy and distribute this software under the conditions of the license below.",
    "SPDX-License-Identifier: LicenseRef-Example",
    "License: Example",
]
#: Words of licences in sentences that license nothing.
TALK = [
    "She lost her driving license on the way to the city.",
    "The council gave permission to use the hall free of charge.",
    "Copies of the book were distributed to the public under the old bridge.",
    "All rooms were reserved for the guests of the general.",
    "The terms of the contract were not met, and the work went on.",
    "The software was modified by a person who used to work there.",
    "He was under no condition to sell the source of his wealth.",
    "The foundation published a later version of the report.",
    "In compliance with the law the file was copied and sold.",
    "It is the copyright of the author that the court discussed.",
]
NONE, UNKNOWN = "none", "unknown"
#: Notices, and the tags that are made of the identifiers.
TEMPLATES: dict[str, list[str]] = {
    family: [
        *notices,
        *(form.format(name) for name in IDENTIFIERS[family] for form in ("SPDX-License-Identifier: {}", "License: {}", "Licensed under {}")),
        *(name for name in IDENTIFIERS[family] if name.startswith(("GPL", "AGPL", "LGPL"))),
    ]
    for family, notices in NOTICES.items()
}
CLASSES = [NONE, UNKNOWN, *TEMPLATES]


def words(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def _grams(found: list[str]) -> set[tuple[str, ...]]:
    return {tuple(found[i : i + n]) for n in (1, 2, 3) for i in range(len(found) - n + 1)}


def _pairs(found: list[str]) -> set[tuple[str, ...]]:
    return {tuple(found[i : i + 2]) for i in range(len(found) - 1)} or {tuple(found)}


_TEMPLATE_PAIRS = {c: [_pairs(words(t)) for t in ts] for c, ts in TEMPLATES.items()}
_TEXTS = [*(t for ts in TEMPLATES.values() for t in ts), *OTHERS]
_KNOWN = {w for t in _TEXTS for w in words(t)}


def resemblance(found: list[str], family: str) -> float:
    """The share of word pairs, of the paragraph's or a template's, that both have; the larger."""
    own = _pairs(found)
    return max(len(own & t) / min(max(len(own), LEAST_PAIRS), len(t)) for t in _TEMPLATE_PAIRS[family])


@dataclass
class Model:
    index: dict[tuple[str, ...], int]
    weights: np.ndarray  # features x classes
    bias: np.ndarray
    temperature: float

    @cached_property
    def silent(self) -> bool:
        """Whether a paragraph without any feature is plain."""
        return bool(self.probabilities([[]])[0, 0] >= 0.5)

    def probabilities(self, rows: list[list[str]]) -> np.ndarray:
        z = _logits(self.index, self.weights, self.bias, rows) / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def _hits(index: dict[tuple[str, ...], int], found: list[str]) -> set[int]:
    """Features of a paragraph: its grams in the index, all of whose words are known."""
    out: set[int] = set()
    run: list[str] = []
    for w in found:
        if w not in _KNOWN:
            run = []
            continue
        run = [*run[-2:], w]
        for n in range(1, len(run) + 1):
            at = index.get(tuple(run[-n:]))
            if at is not None:
                out.add(at)
    return out


def _sparse(index: dict[tuple[str, ...], int], rows: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of every present gram; a row's values are scaled by its length."""
    hits = [sorted(_hits(index, r)) for r in rows]
    sizes = np.array([len(h) for h in hits], np.int64)
    cols = np.array([c for h in hits for c in h], np.int64)
    scale = 1 / np.sqrt(np.array([len(r) + 1 for r in rows], float))
    return np.repeat(np.arange(len(rows)), sizes), cols, np.repeat(scale, sizes)


def _logits(index, weights, bias, rows) -> np.ndarray:
    at, cols, values = _sparse(index, rows)
    return np.stack([np.bincount(at, weights[cols, k] * values, len(rows)) for k in range(weights.shape[1])], 1) + bias


def variants(template: str, n: int, rng: np.random.Generator, filler: list[str]) -> list[list[str]]:
    """The template's words, some dropped, replaced or added, or cut short."""
    base, out = words(template), [words(template)]
    for _ in range(n - 1):
        row = [w for w in base if len(base) < 5 or rng.random() > 0.08]
        if len(row) > 12 and rng.random() < 0.3:
            row = row[: int(rng.integers(8, len(row)))]
        for _ in range(int(rng.integers(0, 4))):
            row.insert(int(rng.integers(0, len(row) + 1)), filler[int(rng.integers(len(filler)))])
        out.append(row or base)
    return out


def train(plain: list[list[str]], seed: int = 3) -> Model:
    """Fit on template variants against plain paragraphs; a fifth is left out for the temperature."""
    rng = np.random.default_rng(seed)
    filler = sorted({w for r in plain[:500] for w in r} - _KNOWN)[:2000] or ["example"]
    rows, y = [], []
    for k, texts in enumerate([TALK, OTHERS, *TEMPLATES.values()]):
        for t in texts:
            made = variants(t, VARIANTS, rng, filler)
            rows += made
            y += [k] * len(made)
    known = sorted(_KNOWN)
    for _ in range(20 * VARIANTS):  # words of licences in no order are no licence
        n = int(rng.integers(4, 30))
        rows.append([known[int(rng.integers(len(known)))] if rng.random() < 0.4 else filler[int(rng.integers(len(filler)))] for _ in range(n)])
        y.append(0)
    common = sorted(_KNOWN.intersection(w for r in plain for w in r)) or ["example"]
    for _ in range(20 * VARIANTS):  # nor are a few of their words that plain paragraphs use as well
        rows.append([common[int(rng.integers(len(common)))] for _ in range(int(rng.integers(1, 4)))])
        y.append(0)
    for w in common:  # and each by itself, as often as a notice varies: "mit" is German as well
        rows += [[w]] * VARIANTS
        y += [0] * VARIANTS
    rows += plain
    y += [0] * len(plain)
    y = np.array(y)
    grams = sorted({g for t in _TEXTS for g in _grams(words(t))})
    index = {g: i for i, g in enumerate(grams)}
    out = rng.random(len(rows)) < 0.2
    at, cols, values = _sparse(index, rows)
    learn = ~out[at]
    at, cols, values = at[learn], cols[learn], values[learn]
    weights, bias = np.zeros((len(grams), len(CLASSES))), np.zeros(len(CLASSES))
    share = np.bincount(y, minlength=len(CLASSES))
    weight = (1 / np.maximum(share, 1))[y] / len(CLASSES)
    weight[out] = 0
    moments = [np.zeros_like(x) for x in (weights, weights, bias, bias)]
    for step in range(1, STEPS + 1):
        z = np.stack([np.bincount(at, weights[cols, k] * values, len(rows)) for k in range(len(CLASSES))], 1) + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        g = p * weight[:, None]
        d = np.stack([np.bincount(cols, g[at, k] * values, len(grams)) for k in range(len(CLASSES))], 1) + 1e-5 * weights
        for i, (x, dx) in enumerate(((weights, d), (bias, g.sum(0)))):
            m, v = moments[2 * i], moments[2 * i + 1]
            m += 0.1 * (dx - m)
            v += 0.01 * (dx * dx - v)
            x -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    held = [r for r, o in zip(rows, out, strict=True) if o]
    z, truth = _logits(index, weights, bias, held), y[out]

    def loss(t: float) -> float:
        q = z / t
        q = q - q.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(q).sum(1)) - q[np.arange(len(truth)), truth]))

    return Model(index, weights, bias, min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss))


def paragraphs(text: str) -> Iterator[tuple[int, list[list[str]]]]:
    """First line and the lines' words of every paragraph."""
    first, held, before, wraps = 0, [], None, False
    for i, line in enumerate(text.split("\n")):
        found = words(line)
        mark = _MARK.match(line)
        kind = mark[1].lower() if mark else ""
        kind = "*" if kind == "/*" else kind
        if held and not (found and ((kind and kind == before) or (wraps and not kind))):
            yield first, held
            held = []
        if found:
            if not held:
                first = i
            held.append(found)
        before = kind
        end = line.rstrip()
        wraps = bool(found) and not kind and WRAP[0] <= len(end) <= WRAP[1] and end[-1] not in ".!?:"
    if held:
        yield first, held


def plain_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[list[str]]:
    """Bounded sample of paragraphs that resemble no template."""
    some = bounded_sample(identified(docs, id_col, text_col), PLAIN_DOCS, "doc_id", "tag")
    some = within_bytes(some, "text", PLAIN_BYTES, "doc_id", "tag").orderBy("doc_id", "tag").select("text").toArrow()
    found = [sum(lines, []) for t in some["text"].to_pylist() for _, lines in paragraphs(t)]
    return [w for w in found if max(resemblance(w, c) for c in TEMPLATES) < CONFIRM]


def judge(model: Model, found: list[list[str]]) -> list[tuple[str, float, float] | None]:
    """Family or ``unknown``, its probability and resemblance; None for plain paragraphs."""
    out: list[tuple[str, float, float] | None] = []
    for p, own in zip(model.probabilities(found), found, strict=True):
        if p[0] >= 0.5:
            out.append(None)
            continue
        best = int(np.argmax(p[1:])) + 1
        alike = resemblance(own, CLASSES[best]) if CLASSES[best] != UNKNOWN else 0.0
        sure = p[best] / (1 - p[0]) >= SURE and alike >= CONFIRM
        out.append((CLASSES[best] if sure else UNKNOWN, float(p[best]), alike))
    return out


def _apart(own: str, family: str, found: list[str]) -> bool:
    """Whether a line names another licence than its paragraph; what both share the line may say of either."""
    return family not in (UNKNOWN, own) and (own == UNKNOWN or resemblance(found, own) < CONFIRM)


def scan_text(model: Model, text: str) -> list[tuple[int, int, str, float, float]]:
    """First line, lines, family, probability and resemblance of a text's licences."""
    units: list[tuple[int, int, list[str]]] = []
    inner: dict[int, range] = {}
    for first, lines in paragraphs(text):
        units.append((first, len(lines), sum(lines, [])))
        if len(lines) > 1:
            inner[len(units) - 1] = range(len(units), len(units) + len(lines))
            units += [(first + i, 1, w) for i, w in enumerate(lines)]
    some = [i for i, u in enumerate(units) if not (model.silent and _KNOWN.isdisjoint(u[2]))]
    verdict = dict(zip(some, judge(model, [units[i][2] for i in some]), strict=True)) if some else {}
    out, i = [], 0
    while i < len(units):
        own, parts = verdict.get(i), inner.get(i, range(0))
        hits = [j for j in parts if verdict.get(j)]
        if own and len(hits) == 1 and verdict[hits[0]][0] == own[0]:
            out.append((*units[hits[0]][:2], *verdict[hits[0]]))  # the other lines are plain
            own = None
        elif hits and (own is None or any(_apart(own[0], verdict[j][0], units[j][2]) for j in hits)):
            out += [(*units[j][:2], *verdict[j]) for j in hits]  # lines of unknown licences too
            own = None
        if own:
            out.append((*units[i][:2], *own))
        i += 1 + len(parts)
    return out


def licence_scan(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, line, n_lines, family, probability, resemblance`` of every paragraph that is some licence's."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the templates' grams, whatever the corpus

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            found = zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True)
            rows = [(doc_id, *row) for doc_id, text in found for row in scan_text(shared.value, text)]
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64()]
                names = ["doc_id", "line", "n_lines", "family", "probability", "resemblance"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    rows = identified(docs, id_col, text_col).select("doc_id", "text")
    return rows.mapInArrow(scan, "doc_id long, line int, n_lines int, family string, probability double, resemblance double")


def op7(docs: DataFrame) -> DataFrame:
    return licence_scan(docs, train(plain_paragraphs(docs)))
