import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.llm import packing, token_counts, token_files
from lacuna.llm.encoding import Encoder, default_tokenizer


@pytest.fixture(scope="module")
def encoder():
    return Encoder(default_tokenizer())


def plain(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("special_as_text", [False, True])
def test_ids_equal_the_librarys(texts, special_as_text):
    e = Encoder(default_tokenizer(), special_as_text)
    rnd = random.Random(3)
    bits = ["a", "é", "日", "B", " ", "\n", "\t", ".", "!!", "'s", "'", "1", "<|endoftext|>", "the", "'ll", "\r\n", " x", "ñ", "ß", " ", "Ω"]
    odd = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14))) for _ in range(4000)]
    for _ in range(2):  # once new, once remembered
        for t, ids in zip(odd, e.encode(odd), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain(e, t), repr(t)
    some = list(texts.values())[:50]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(some)] == [plain(e, t) for t in some]


def test_records_round_trip(spark, documents, texts, encoder):
    manifest = token_files.write_records(documents)
    rows = token_files.read_records(manifest).orderBy("doc_id").collect()
    start = 0
    for r in rows:
        ids = [*plain(encoder, texts[r.doc_id]), 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(rows) == len(texts)
    one = manifest.orderBy("part").head()
    doc_id, ids = token_files.read_record(one.path, 3)
    assert ids.tolist() == [*plain(encoder, texts[doc_id]), 2]


def test_damage_is_noticed():
    whole = token_files.frame(7, np.arange(5, dtype="<u4").tobytes(), False)
    assert token_files.unframe(whole, 0)[0] == 7
    wide = token_files.frame(None, np.array([1 << 20], "<u4").tobytes(), True)
    assert token_files.unframe(wide, 0)[:2] == (None, np.array([1 << 20], "<u4").tobytes())
    for at in (0, 9, 15, len(whole) - 1):
        bad = bytearray(whole)
        bad[at] ^= 1
        with pytest.raises(ValueError, match="checksum"):
            token_files.unframe(bytes(bad), 0)


def test_counts_do_not_depend_on_blocks(documents, texts, encoder):
    order = token_counts.write_flat(documents)
    files = order.filter("path is not null")
    whole, small = (token_counts.scan_flat(files, block_ids=n).orderBy("file", "ordinal").collect() for n in (1 << 20, 37))
    assert whole == small
    found = {r.doc_id: r.n_tokens for r in token_counts.op4(documents).collect()}
    assert found == {i: len(plain(encoder, t)) + 1 for i, t in texts.items()}


def check_packing(rows, texts, encoder, capacity=2048):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for i, rs in by_doc.items():
        ids = np.array([*plain(encoder, texts[i]), 1], "<u4")
        at = 0
        for r in sorted(rs, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for rs in by_sequence.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding / sum(r.length for r in rows)


def test_packing(documents, texts, encoder):
    assert check_packing(packing.op5(documents).collect(), texts, encoder) < 0.02


@pytest.mark.parametrize("n", [1, 63, 64, 65, 2047, 2048, 2049, 5000])
def test_cuts(n):
    sizes = packing.cuts(n)
    assert sum(sizes) == n and max(sizes) <= 2048 and all(s == 2048 or s & (s - 1) == 0 or s < 64 for s in sizes)


def test_awkward_rows(awkward, nothing):
    n = awkward.count()
    assert token_files.op8(awkward).count() == n and token_files.op8(nothing).count() == 0
    assert token_counts.op4(awkward).count() == n and token_counts.op4(nothing).count() == 0
    rows = packing.op5(awkward)
    assert rows.filter("start = 0").count() == n and packing.op5(nothing).count() == 0
    assert token_counts.op4(awkward).filter("doc_id = 1").head().n_tokens == 1
    starts = token_files.op8(awkward).agg(F.countDistinct("start")).head()[0]
    assert starts == n
