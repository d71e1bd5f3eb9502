import math
import zlib

import numpy as np
import pytest
from helpers import compare

from lacuna.llm import ann, decontaminate, licenses, queries, toxicity


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_toxicity_held_out(spark, sf_dir, size):
    path = sf_dir.replace("sf0.001", size)
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.op3(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    toxic = [r.score for r in held if r.toxic]
    clean = [r.score for r in held if not r.toxic]
    above = np.mean([[t > c for c in clean] for t in toxic])
    assert above > 0.85
    assert np.mean([t >= 0.3 for t in toxic]) > 0.65
    assert np.mean([c < 0.3 for c in clean]) > 0.93


def plain_score(model, text):
    """The score of a text by plain loops, from the trained table and bias alone."""
    full, mul, turn = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F

    def rows(word):
        points = [(ord(c) + 1) * mul & full for c in f"<{word}>"]
        points = [p ^ (p >> 29) for p in points]
        found = [(sum(p * (2 * i + 1) for i, p in enumerate(points)) * mul + 99) & full]
        for n in (3, 4, 5):
            for i in range(len(points) - n + 1):
                rolled = 0
                for p in points[i : i + n]:
                    rolled = (rolled * turn & full) ^ p
                found.append((rolled * mul + n) & full)
        return [((r ^ (r >> 33)) * mul & full) >> 46 for r in found]

    pulls, last = [], {}
    for i, token in enumerate(text.lower().split()):
        if token not in last or i - last[token] > 48:
            own = rows(token.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»…–—“”‘’"))
            pulls.append(sum(model.pull[r] for r in own) / len(own))
        last[token] = i
    width = min(48, len(pulls))
    best = max((sum(pulls[i : i + width]) / max(width, 24) for i in range(len(pulls) - width + 1)), default=0.0) if pulls else 0.0
    return 1 / (1 + math.exp(-max(-500, min(500, best + model.bias))))


def test_scores_equal_plain_loops(spark, documents, texts, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(toxicity.sample(documents, labels))
    found = {r.doc_id: r.score for r in toxicity.op3(documents, labels).collect()}
    assert set(found) == set(texts) and model.pull.any()
    for i in sorted(texts)[:80]:
        assert found[i] == pytest.approx(plain_score(model, texts[i] or ""), abs=1e-9)


def test_whole_long_texts_are_sampled(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 200_000)
    docs = spark.createDataFrame([(i, f"word{i} " * (20_000 if i == 3 else 5)) for i in range(8)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, toxic int")
    rows = toxicity.sample(docs, labels, held_out=None).collect()
    assert len(rows) == 8 and sum(r.y for r in rows) == 4 and max(len(r.text) for r in rows) == 120_000
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 100_000)
    assert 0 < toxicity.sample(docs, labels, held_out=None).count() < 8


def test_misspellings_share_ngrams():
    texts = [f"a quiet day with some {w} around here number {i}" for i, w in enumerate(["horrible", "pleasant"] * 60)]
    model = toxicity.train(texts, [1, 0] * 60)
    scores = toxicity.score_texts(model, ["what a horribble thing", "what a pleasannt thing", ""], {})
    assert scores[0] > scores[1] and 0 <= scores[2] <= 1
    assert toxicity.score_texts(toxicity.train(["x"], [0]), ["x"], {})[0] == pytest.approx(0)


def test_licences(spark):
    lines = [
        "Licensed under the Apache License, Version 2.0.",
        "This software is licensed under the MIT licence",
        "Distributed under the Eclipse Public License 2.0",
        "licensed under a Creative Commons Attribution-ShareAlike 3.0 license",
        "the cat sat on the mat and was of no use to the people",
        "see the license",
    ]
    df = spark.createDataFrame([(7, "\n".join(lines))], "doc_id long, text string")
    found = {r.line: r.family for r in licenses.op7(df).collect()}
    assert found.pop(5, "unknown") == "unknown"
    assert found == {0: "Apache-2.0", 1: "MIT", 2: "unknown", 3: "CC-BY-SA"}


@pytest.fixture(scope="module")
def licence_model(documents):
    return licenses.train(licenses.plain_paragraphs(documents))


#: Phrasings that no training text has, and what they are.
PHRASINGS = {
    "SPDX-License-Identifier: MIT": "MIT",
    " * SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0",
    "# SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    "SPDX-License-Identifier: Zlib": "unknown",
    "License: Zlib": "unknown",
    "license = \"MIT\"": "MIT",
    "GPLv3": "GPL-3.0",
    "The Unlicense": "Unlicense",
    "This code has been released under the Unlicense": "Unlicense",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted": "ISC",
    "This module is free software; you may redistribute it and/or modify it under the terms of the GNU General Public License, version 2": "GPL-2.0",
    "The library is released under the MIT License (see LICENSE).": "MIT",
    "Licensed to you under the Apache License, Version 2.0": "Apache-2.0",
    "This documentation is made available under a Creative Commons Attribution 4.0 International License": "CC-BY",
    "Distributed under the Boost Software License, Version 1.0.": "unknown",
    "Licensed under the EUPL, Version 1.2 or later": "unknown",
    "The PostgreSQL License permits use, copying and distribution of this software without fee": "unknown",
    "He got his license at the age of 18 and drove to the public beach.": None,
    "Copies of the map were sold to the public in the general store.": None,
    "The version of the story that she told was never published.": None,
    "mit": None,
}


def test_licence_phrasings(licence_model):
    found = {p: [r[2] for r in licenses.scan_text(licence_model, p)] for p in PHRASINGS}
    wrong = {p: f for p, f in found.items() if f != ([PHRASINGS[p]] if PHRASINGS[p] else [])}
    assert not wrong


def test_licence_paragraphs(licence_model):
    header = """\
// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.
//
// Unless required by applicable law or agreed to in writing, software
// distributed under the License is distributed on an "AS IS" BASIS,
// WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.

int main() { return 0; }
This program is free software: you can redistribute it and/or modify it
under the terms of the GNU General Public License as published by the
Free Software Foundation, either version 3 of the License, or later."""
    found = [r[:3] for r in licenses.scan_text(licence_model, header)]
    assert found == [(0, 2, "Apache-2.0"), (3, 3, "Apache-2.0"), (8, 3, "GPL-3.0")]
    comment = "# the sea was calm\n# and so were we\n# Released under the MIT License.\n# until the morning came"
    assert [r[:3] for r in licenses.scan_text(licence_model, comment)] == [(2, 1, "MIT")]
    long = "the quiet sea of the north\n" * 50_000
    assert [r[:3] for r in licenses.scan_text(licence_model, f"{long}Released under the MIT License.\n{long}")] == [(50_000, 1, "MIT")]


def test_licence_probabilities_equal_plain_loops(licence_model):
    model = licence_model
    for text in [*PHRASINGS, "Released under the MIT License.", "no words of any kind", ""]:
        found = licenses.words(text)
        grams = {tuple(found[i : i + n]) for n in (1, 2, 3) for i in range(len(found) - n + 1)}
        z = []
        for k in range(len(licenses.CLASSES)):
            z.append((model.bias[k] + sum(model.weights[model.index[g]][k] for g in grams if g in model.index) / math.sqrt(len(found) + 1)) / model.temperature)
        e = [math.exp(x - max(z)) for x in z]
        assert model.probabilities([found])[0].tolist() == pytest.approx([x / sum(e) for x in e])


def test_licence_ties(licence_model):
    """Two families alike: the first of them, and not sure of either."""
    flat = licenses.Model(licence_model.index, np.zeros_like(licence_model.weights), np.zeros(len(licenses.CLASSES)), 1.0)
    assert licenses.judge(flat, [["some", "words"]]) == [("unknown", pytest.approx(1 / len(licenses.CLASSES)), 0.0)]
    assert not flat.silent and len(licenses.scan_text(flat, "some words")) == 1


def test_licences_of_the_documents(documents, texts):
    notices = {
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "Released under the MIT License.": "MIT",
        "All rights reserved.": "proprietary",
    }
    expected = {(i, n, notices[line]) for i, t in texts.items() for n, line in enumerate(t.split("\n")) if line in notices}
    assert {(r.doc_id, r.line, r.family) for r in licenses.op7(documents).collect()} == expected


def test_decontamination_agrees_with_duckdb(spark, sf_dir):
    path = sf_dir.replace("sf0.001", "sf0.01")
    assert compare(spark, path, "op10", queries.op10_decontaminate, queries.ORACLE_SQL["op10_decontaminate"]) > 10


def test_decontamination_small(spark):
    item = " ".join(f"w{i}" for i in range(30))
    near = item.replace("w15", "other")
    far = " ".join("x" if i % 6 == 5 else f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"a b. {item}, c"), (2, near), (3, far), (4, "alpha"), (5, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, "alpha"), (3, None), (4, "")], "item_id long, text string")
    found = {(r.doc_id, r.item_id): (r.start, round(r.similarity, 4)) for r in decontaminate.op10(docs, items).collect()}
    # one word replaced in thirty: 21 shared shingles of 26 on either side, 21 / 31
    assert found == {(1, 1): (2, 1.0), (4, 2): (0, 1.0)}
    edge = " ".join(["other", *item.split()[1:]])
    docs = spark.createDataFrame([(2, edge)], "doc_id long, text string")
    assert [round(r.similarity, 4) for r in decontaminate.op10(docs, items).collect()] == [round(25 / 27, 4)]


def test_recall(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.1')}/embeddings.parquet")
    rows = table.toPandas()
    vectors, ids = np.stack(rows.embedding).astype(float), rows.vec_id.to_numpy()
    found = {}
    for r in ann.op9(table).collect():
        found.setdefault(r.query_id, []).append(r)
    hits = 0
    assert set(found) == {int(i) for i in ids if i % 100 == 0}
    for q, rs in found.items():
        at = np.flatnonzero(ids == q)[0]
        distance = np.sqrt(((vectors - vectors[at]) ** 2).sum(1))
        best = [v for _, v in sorted((d, v) for d, v in zip(distance, ids, strict=True) if v != q)[:10]]
        rs.sort(key=lambda r: r.rank)
        assert [r.rank for r in rs] == list(range(1, 11))
        assert [r.score for r in rs] == pytest.approx([distance[np.flatnonzero(ids == r.vec_id)[0]] for r in rs], rel=1e-12)
        hits += len({r.vec_id for r in rs} & set(best))
    assert hits >= 0.9 * 10 * len(found)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.0, 0.0]), (1, None), (2, [1.0, None]), (3, [1.0, nan]), (7, [inf, 1.0]), (6, [1.0]), (None, [1.0, 2.0]), (9, [])]
    rows += [(100, [1.0, 2.0]), (4, [1.0, 2.0]), (4, [1.0, 2.0]), (5, [1.0, 2.5]), (200, [1.0, 2.0]), (300, [-0.0, 1.0]), (8, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = {}
    for r in ann.op9(df).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 3)))
    assert found[100] == [(4, 0.0), (200, 0.0), (5, 0.5), (8, 1.414), (300, 1.414)]
    assert found[300][0] == (8, 0.0) and len(found[300]) == 5
    assert ann.op9(df.limit(0)).count() == 0
    many = [(100, [1.0, 2.0])] + [(1000 + 7 * i, [1.0, 2.0]) for i in range(40)]
    near = ann.op9(spark.createDataFrame(many, "vec_id long, embedding array<float>")).filter("query_id = 100").orderBy("rank")
    assert [r.vec_id for r in near.collect()] == [1000 + 7 * i for i in range(10)]


def test_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 0), (4, 1), (None, 1), (6, None)], "doc_id long, toxic int")
    n = awkward.count()
    assert toxicity.op3(awkward, labels).count() == n and toxicity.op3(nothing, labels).count() == 0
    assert toxicity.op3(awkward, labels.limit(0)).filter("score > 0.01").count() == 0
    model = licenses.train(licenses.plain_paragraphs(awkward))
    assert licenses.licence_scan(awkward, model).count() == 0 and licenses.op7(nothing).count() == 0
    items = spark.createDataFrame([(1, "another text under the same id"), (2, None)], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.op10(awkward, items).collect()] == [(4, 1)]
    assert decontaminate.op10(nothing, items).count() == 0 and decontaminate.op10(awkward, items.limit(0)).count() == 0
    left = decontaminate.without_leaks(awkward, items)
    assert left.count() == n - 1 and left.columns == awkward.columns


def test_clashing_columns(spark):
    rows = [(100 * i, [float(i), 1.0], 1, 2.0, "x") for i in range(3)] + [(7, [0.5, 1.0], 3, None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score double, query_id string")
    found = ann.op9(df).filter("query_id = 0").orderBy("rank").collect()
    assert [r.vec_id for r in found] == [7, 100, 200]
    docs = spark.createDataFrame([(1, "one two three four five six", 3, "i")], "doc_id long, text string, start int, item_id string")
    items = spark.createDataFrame([(5, "one two three four five six", 9, "v")], "item_id long, text string, doc_id int, variant string")
    assert [(r.doc_id, r.item_id, r.start) for r in decontaminate.op10(docs, items).collect()] == [(1, 5, 0)]


def test_shared_shingles_cost_no_item(spark):
    """Items that share most of their shingles, and a very long text of one of them."""
    common = " ".join(f"c{i}" for i in range(30))
    items = spark.createDataFrame([(i, f"{common} own{i} end{i}") for i in range(20)], "item_id long, text string")
    long = "word " * 200_000
    docs = spark.createDataFrame([(1, f"{long}{common} own3 end3 {long}"), (2, common), (3, "c0 c1 c2 c3 c4 " * 50)], "doc_id long, text string")
    found = {(r.doc_id, r.item_id): round(r.similarity, 3) for r in decontaminate.op10(docs, items).collect()}
    # 26 of 28 shingles in any item: 26 / 30 beside the item itself, and 26 / 28 for the common words alone
    assert found == {(1, i): 1.0 if i == 3 else round(26 / 30, 3) for i in range(20)} | {(2, i): round(26 / 28, 3) for i in range(20)}
