import pytest

from lacuna.llm import licenses

PLAIN = ["er kam mit dem zug und ging mit der zeit", "the work of the general was free to any person who used it", "das ist das ende der fahrt"] * 20


@pytest.fixture(scope="module")
def model():
    return licenses.train([licenses.words(p) for p in PLAIN])


def test_notices_that_follow_each_other_stay_apart(model):
    lines = [
        "This software is licensed under the MIT licence",
        "Distributed under the Eclipse Public License 2.0",
        "licensed under a Creative Commons Attribution-ShareAlike 3.0 license",
    ]
    assert [len(p) for _, p in licenses.paragraphs("\n".join(lines))] == [3]
    for order in ([0, 1, 2], [2, 1, 0], [1, 0, 2]):
        found = [r[:3] for r in licenses.scan_text(model, "\n".join(lines[i] for i in order))]
        assert found == [(n, 1, ["MIT", "unknown", "CC-BY-SA"][i]) for n, i in enumerate(order)]


def test_a_wrapped_notice_stays_whole(model):
    header = """\
This program is free software; you can redistribute it and/or modify it
under the terms of the GNU General Public License as published by the
Free Software Foundation; either version 2 of the License, or (at your
option) any later version."""
    assert [r[:3] for r in licenses.scan_text(model, header)] == [(0, 4, "GPL-2.0")]
    permission = """\
Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files, to deal in the Software
without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software."""
    assert [r[:3] for r in licenses.scan_text(model, permission)] == [(0, 5, "MIT")]


def test_a_word_of_the_corpus_alone_is_no_licence(model):
    assert not [w for w in ("mit", "general", "free", "person", "work") if licenses.scan_text(model, w)]
    assert [r[2] for r in licenses.scan_text(model, "License: MIT")] == ["MIT"]
