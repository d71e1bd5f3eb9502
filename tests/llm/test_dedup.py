import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import compare
from pyspark.sql import functions as F

from lacuna.llm import line_dedup, queries, simhash, suffix_dedup
from lacuna.llm.components import components


def brute(texts, n):
    blobs = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + n] for b in blobs for i in range(len(b) - n + 1))
    out = []
    for b in blobs:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        left = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize(("letters", "crowd"), [("abcdefgh ", 4096), ("ab", 4096), ("abcdefgh ", 2)])
def test_suffix_dedup_against_brute_force(spark, letters, crowd):
    rnd = random.Random(len(letters) + crowd)
    base = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 400))) for _ in range(12)]
    texts = list(base)
    for _ in range(30):
        a, b = rnd.choice(base), rnd.choice(base)
        i, j = sorted((rnd.randint(0, len(a)), rnd.randint(0, len(a))))
        q = rnd.randint(0, len(b))
        texts.append(b[:q] + a[i:j] + b[q:])
    texts += [None, "", "a" * 300, "ab" * 100, "x" * 39, "y" * 40, "z" * 41, "é" * 60]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = suffix_dedup.suffix_dedup(df, length=40, prefix=20, crowd=crowd).orderBy("doc_id").collect()
    found = [(r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in rows]
    assert found == brute(texts, 40)


def test_op1(documents, texts):
    rows = queries.suffix_dedup.op1(documents).orderBy("doc_id").collect()
    ids = sorted(texts)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows] == brute([texts[i] for i in ids], 400)
    whole = [r for r in rows if not r.n_removed]
    assert whole and all(r.text == texts[r.doc_id] for r in whole)
    assert any(hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 for r in rows if r.n_removed)


def test_blocks_of_long_texts_agree(monkeypatch):
    rnd = np.random.default_rng(1)
    data = rnd.integers(97, 101, 5000).astype(np.uint8)
    data[1000:1400] = 97
    whole = suffix_dedup.runs(data, 40, 20)
    monkeypatch.setattr(suffix_dedup, "_BLOCK", 600)
    for a, b in zip(whole, suffix_dedup.runs(data, 40, 20), strict=True):
        assert (a == b).all()


def test_multikey_order():
    rnd = random.Random(5)
    rows = [bytes(rnd.choice(b"\0ab") for _ in range(20)) for _ in range(300)] + [b"same" * 5] * 3
    order, shared = suffix_dedup.multikey_order(rows, 20)
    ordered = [rows[i] for i in order]
    assert ordered == sorted(rows)
    for k in range(1, len(rows)):
        a, b = ordered[k - 1], ordered[k]
        assert shared[k] == next((i for i in range(20) if a[i] != b[i]), 20)


def test_line_dedup_agrees_with_duckdb(spark, sf_dir):
    compare(spark, sf_dir, "op2", queries.op2_line_dedup, queries.ORACLE_SQL["op2_line_dedup"])


def test_line_dedup_small(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "q\nq\nq\nq"), (4, "a\nb")]
    found = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_removed, r.text) for r in found] == [(0, "a\nb\nc\nd"), (3, "x\ny"), (3, "q"), (0, "a\nb")]


def reach(fps, radius=3):
    n, root = len(fps), list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i + 1, n):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_op6(spark, documents, texts):
    rows = queries.simhash.op6(documents).orderBy("doc_id").collect()
    native = documents.selectExpr(
        "doc_id",
        r"filter(split(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), x -> x != '') AS w",
    ).selectExpr("doc_id", "explode(transform(sequence(0, greatest(size(w) - 3, 0)), i -> xxhash64(concat_ws(' ', slice(w, i + 1, 3))))) AS h")
    sums = [F.sum(F.shiftright("h", i).bitwiseAND(F.lit(1))) * 2 > F.count("*") for i in range(64)]
    native = {r[0]: sum(1 << i for i in range(64) if r[i + 1]) for r in native.groupBy("doc_id").agg(*sums).collect()}
    assert {r.doc_id: int(r.fingerprint, 16) for r in rows} == native
    ids = [r.doc_id for r in rows]
    assert [r.component_id for r in rows] == [ids[i] for i in reach([int(r.fingerprint, 16) for r in rows])]


@pytest.mark.parametrize("crowd", [4096, 4])
def test_links_span_the_graph(spark, crowd):
    rnd = random.Random(2)
    points = set()
    for _ in range(5):
        base = rnd.getrandbits(64)
        points.add(base)
        for _ in range(60):
            x = base
            for _ in range(rnd.randint(1, 6)):
                x ^= 1 << rnd.randrange(64)
            points.add(x)
    points = sorted(points)
    df = spark.createDataFrame([(simhash._signed(x),) for x in points], "fp long")
    part = {r.node: r.component for r in components(simhash.links(df, crowd=crowd)).collect()}
    groups = {}
    for x, r in zip(points, reach(points), strict=True):
        groups.setdefault(part.get(simhash._signed(x), ("alone", x)), set()).add(r)
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(reach(points)))


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (103, 100)]
    found = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 103: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_awkward_rows(awkward, nothing):
    n = awkward.count()
    rows = suffix_dedup.op1(awkward)
    assert rows.count() == n and suffix_dedup.op1(nothing).count() == 0
    assert rows.filter("doc_id = 5").head().n_removed == 300_000
    rows = line_dedup.line_dedup(awkward, rest=True)
    assert rows.count() == n and line_dedup.line_dedup(nothing).count() == 0
    assert rows.filter("doc_id = 7").head().n_removed == 50
    assert rows.select("rest.*").columns == awkward.columns
    rows = simhash.op6(awkward)
    assert rows.count() == n and simhash.op6(nothing).count() == 0
    empty = rows.filter("doc_id <= 3 or doc_id = 7").collect()
    assert {(r.fingerprint, r.component_id) for r in empty} == {("0" * 16, 1)}
    kept = simhash.without_near_duplicates(awkward)
    assert kept.columns == awkward.columns and kept.filter("doc_id = 4 and text = 'one'").count() == 1
    assert kept.filter("doc_id is null").count() == 1


def test_release_deletes_what_was_written(spark):
    from lacuna.llm import common

    common.release(spark)
    frame = common.cut(spark.range(3), "numbers")
    assert frame.count() == 3 and common.release(spark) == 1 and common.release(spark) == 0
