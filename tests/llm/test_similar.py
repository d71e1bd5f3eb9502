"""The pipeline's near-duplicate stage against brute-force five-word Jaccard."""

import random

import pytest

import corpus_pipeline
from lacuna.llm import similar, simhash


def survivors(texts):
    """Smallest ids of the groups linked at a similarity of 0.8, by comparing all pairs."""
    sets = {i: frozenset(simhash.shingle_hashes(t or "", 5)) for i, t in texts.items()}
    ids, group = sorted(texts), {i: i for i in texts}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for at, i in enumerate(ids):
        for j in ids[at + 1 :]:
            shared, union = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if (sets[i] == sets[j] or 5 * shared >= 4 * union) and find(i) != find(j):
                x, y = sorted((find(i), find(j)))
                group[y] = x
    return {find(i) for i in ids}


def invented():
    """Near copies around the threshold, a crowd of copies of one text, and a passage all texts hold."""
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage, texts = rng.choices(vocabulary, k=12), []
    for _ in range(40):
        base = rng.choices(vocabulary, k=rng.randint(5, 200)) + passage
        texts.append(base)
        for edits in range(1, 5):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(copy)
    base = rng.choices(vocabulary, k=120)
    for _ in range(120):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        texts.append(copy)
    rng.shuffle(texts)
    return {i: " ".join(t) for i, t in enumerate(texts)} | {9000: "", 9001: None, 9002: "one two", 9003: "ONE  two"}


@pytest.mark.parametrize(("crowd", "rounds"), [(similar.CROWD, similar.ROUNDS), (1, 1), (8, 0)])
def test_invented(spark, monkeypatch, crowd, rounds):
    monkeypatch.setattr(similar, "CROWD", crowd)
    monkeypatch.setattr(similar, "ROUNDS", rounds)
    texts = invented()
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, lang string")
    expected = survivors(texts)
    kept = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(kept) == sorted(expected)
    wide = {r.doc_id for r in simhash.without_near_duplicates(docs).collect()}
    assert wide - expected  # three bits leave some of these


def test_documents(spark, documents, texts):
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, documents, "").collect()}
    assert kept == survivors(texts)


def test_awkward(awkward, nothing):
    kept = similar.without_similar(awkward)
    assert kept.columns == awkward.columns
    assert similar.without_similar(nothing).collect() == []
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 4, 5, 6]


def test_shared_passage(spark, monkeypatch):
    """Texts that share a passage of two thirds of their words are few candidates, not all pairs at each of its shingles."""
    rng, seen, check = random.Random(3), [], similar._verified
    vocabulary = [f"w{i}" for i in range(5000)]
    passage = rng.choices(vocabulary, k=200)
    texts = {i: " ".join(passage + rng.choices(vocabulary, k=rng.randint(90, 110))) for i in range(60)}

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return check(pairs, *rest)

    monkeypatch.setattr(similar, "_verified", counted)
    monkeypatch.setattr(similar, "OFTEN", 1000)  # as in a table so large that the sample misses the passage
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert similar.without_similar(docs).count() == len(survivors(texts)) == len(texts)
    assert seen[-1] < len(texts)


def test_lengths_around_powers_of_two(spark):
    """Pairs at and below the threshold whose parities are of one length or of two; long sets among them."""
    rng, texts = random.Random(5), {}
    vocabulary = [f"w{i}" for i in range(9000)]
    for size in (50, 62, 70, 120, 500, 512, 520, 900, 1000, 1030, 3700, 4090):
        for share in (0.7, 0.78, 0.79, 0.8, 0.81, 0.9):
            base = rng.choices(vocabulary, k=size + 4)
            more = round(size / share) - size
            texts |= {len(texts): " ".join(base), len(texts) + 1: " ".join(base + rng.choices(vocabulary, k=more))}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = sorted(r.doc_id for r in similar.without_similar(docs).collect())
    assert kept == sorted(survivors(texts)) and len(texts) / 2 < len(kept) < len(texts)
