"""Exact substring dedup over a range-partitioned, sparse suffix array.

Removed is every byte covered by a ``LENGTH``-byte string that also starts
anywhere else, in the same document or another; strings never cross documents.

1. *Sparse suffixes.*  Each LENGTH-byte window keeps one suffix: that of its
   smallest PREFIX-gram by a rolling hash (leftmost among equals).  Equal windows
   keep equal suffixes at equal offsets, so nothing is lost, while about two
   positions in LENGTH - PREFIX + 2 remain.  The windows that share a suffix form
   a run of starts; the run's bytes from its first to its last window are its span.
2. *Counts.*  Suffixes whose PREFIX bytes (by hash) occur once go.  Runs whose
   whole spans occur twice or more are covered outright.
3. *Buckets.*  One run of every distinct span is range-partitioned by the leading
   bytes of its suffix: Spark samples the splitters.  A bucket sorts its suffixes
   by multikey quicksort, eight bytes a key, which also gives the common prefix
   of neighbours.  Two windows that begin l bytes before their suffixes are equal
   if the suffixes share LENGTH - l bytes and the l bytes before them are the same.
   Equal leading bytes never straddle two buckets.  Suffixes that share their
   PREFIX bytes with more than ``crowd`` others in distinct spans are dealt out
   instead by the hash of each window, so no task holds an unbounded group; that
   is the comparison across boundaries.
4. Covered spans are merged per document and cut out.

Null text is empty.  Texts shorter than LENGTH bytes have no windows and stay
whole.  Rows are known by (doc_id, checksum of the text): repeated rows are
copies of each other, so both lose what they share; null ids are kept.  An empty
table gives no rows.  Columns besides the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, identified, same_doc, text_slices

LENGTH = 400
#: Bytes that two suffixes must share to be compared at all.
PREFIX = 200
#: Leading bytes that the range partitioning sees.
LEAD = 24
#: Distinct spans over one prefix up to which a bucket compares them itself.
CROWD = 4096

_BASE = 0x9E3779B97F4A7C15
_BLOCK = 1 << 18
_U = np.uint64


def _powers(n: int, base: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0], have = 1, 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * _U(pow(base, have, 1 << 64))
        have += more
    return out


_UP, _DOWN = _powers(_BLOCK + 1, _BASE), _powers(_BLOCK + 1, pow(_BASE, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(29))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


def _prefix_sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * _UP[: len(data)], out=out[1:])
    return out


def _gram_hashes(sums: np.ndarray, n: int) -> np.ndarray:
    return _mixed((sums[n:] - sums[:-n]) * _DOWN[: len(sums) - n])


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def runs(data: np.ndarray, length: int = LENGTH, prefix: int = PREFIX):
    """``(first start, last start, suffix hash, span hash)`` of every run of a text's windows.

    Long texts go block by block, with an overlap in which every run ends.
    """
    step = _BLOCK - 4 * length
    parts = []
    for at in range(0, max(1, len(data) - length + 1), step):
        block = data[at : at + _BLOCK]
        if len(block) < length:
            break
        sums = _prefix_sums(block)
        grams = _gram_hashes(sums, prefix)
        least = _window_min(grams, length - prefix + 1)
        own = grams[: len(least)] == least
        fresh = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | own[:-1])))
        last = np.append(fresh[1:] - 1, len(least) - 1)
        final = at + _BLOCK >= len(data)
        # a block owns the runs that start in it, up to the next block's first start
        whole = ((fresh > 0) | (at == 0)) & (final | (fresh <= step))
        fresh, last = fresh[whole], last[whole]
        span = _mixed((sums[last + length] - sums[fresh]) * _DOWN[fresh])
        span = _mixed(span + (last - fresh).astype(np.uint64) * _U(0x2545F4914F6CDD1D))
        parts.append((fresh + at, last + at, least[fresh], span))
        if final:
            break
    if not parts:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),) * 2
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _suffixes(docs: DataFrame, length: int, prefix: int) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            rows, found = [], []
            for i, text in enumerate(batch["text"].to_pylist()):
                data = np.frombuffer(text.encode(), np.uint8)
                if len(data) >= length:
                    found.append(runs(data, length, prefix))
                    rows.append(np.full(len(found[-1][0]), i))
            if not found:
                continue
            first, last, key, span = (np.concatenate(c) for c in zip(*found, strict=True))
            row = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].take(row),
                    batch["tag"].take(row),
                    pa.array(first.astype(np.int64)),
                    pa.array((last - first).astype(np.int32)),
                    pa.array(key.view(np.int64)),
                    pa.array(span.view(np.int64)),
                ],
                names=["doc_id", "tag", "first", "more", "key", "span"],
            )

    return docs.mapInArrow(emit, "doc_id long, tag int, first long, more int, key long, span long")


def multikey_order(rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte strings padded to ``width``, and each one's common prefix with the one before.

    Multikey quicksort, eight bytes a character: ties of one character are parted
    by the next, and strings that stand alone take no further part.
    """
    n = len(rows)
    words = -(-width // 8)
    table = np.frombuffer(b"".join(r.ljust(words * 8, b"\0") for r in rows), ">u8").reshape(n, words).astype(np.uint64)
    order = np.arange(n)
    shared = np.zeros(n, np.int64)
    group = np.zeros(n, np.int64)  # of each place in the order
    live = np.arange(n)  # places still tied
    for k in range(words):
        if len(live) < 2:
            break
        word = table[order[live], k]
        by = np.lexsort((word, group[live]))
        order[live], word = order[live][by], word[by]
        parted = np.empty(len(live), bool)
        parted[0] = True
        same_group = group[live][1:] == group[live][:-1]
        differs = word[1:] != word[:-1]
        parted[1:] = ~same_group | differs
        tie = np.flatnonzero(~parted)
        shared[live[tie]] = 8 * (k + 1)
        edge = np.flatnonzero(same_group & differs) + 1
        if len(edge):  # the first differing byte within the word
            x = word[edge] ^ word[edge - 1]
            lead = np.zeros(len(x), np.int64)
            rest = x
            for shift in (32, 16, 8):
                low = rest < (_U(1) << _U(64 - shift))
                lead += np.where(low, shift // 8, 0)
                rest = np.where(low, rest << _U(shift), rest)
            shared[live[edge]] = 8 * k + lead
        group[live] = live[np.maximum.accumulate(np.where(parted, np.arange(len(live)), 0))]
        keep = ~parted
        keep[:-1] |= ~parted[1:]
        live = live[keep]
    return order, np.minimum(shared, width)


def repeated_windows(befores: list[bytes], afters: list[bytes], mores: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """Which of each run's windows equal another run's; a run's whole group must be among them.

    ``befores`` holds the bytes from a run's first window to its suffix, ``afters``
    the suffix itself up to the end of the last window.
    """
    n = len(afters)
    order, shared = multikey_order(afters, length)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    # hash of the l bytes before each suffix, for every l that the run has
    sums = [_prefix_sums(np.frombuffer(b, np.uint8)) for b in befores]
    ls, who, left = [], [], []
    for i, (b, m) in enumerate(zip(befores, mores, strict=True)):
        l_of = len(b) - np.arange(m + 1)
        ls.append(l_of)
        who.append(np.full(m + 1, i))
        left.append((sums[i][len(b)] - sums[i][len(b) - l_of]) * _DOWN[len(b) - l_of])
    ls, who, left = np.concatenate(ls), np.concatenate(who), _mixed(np.concatenate(left))
    # suffixes that share length - l bytes stand together: number those blocks for each l
    found = np.zeros(len(ls), bool)
    by_l = np.argsort(ls, kind="stable")
    cuts = np.flatnonzero(np.diff(ls[by_l])) + 1
    for part in np.split(by_l, cuts):
        block = np.cumsum(shared < length - ls[part[0]])[rank[who[part]]]
        by = np.lexsort((left[part], block))
        b, h = block[by], left[part][by]
        same = (b[1:] == b[:-1]) & (h[1:] == h[:-1])
        hit = np.zeros(len(part), bool)
        hit[1:] |= same
        hit[:-1] |= same
        found[part[by[hit]]] = True
    return np.split(found, np.cumsum(np.array(mores) + 1)[:-1])


def _intervals(first: int, hit: np.ndarray, length: int) -> list[tuple[int, int]]:
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    gap = np.flatnonzero(np.diff(at) > 1)
    begin, end = at[np.append(0, gap + 1)], at[np.append(gap, len(at) - 1)]
    return [(first + int(a), first + int(b) + length) for a, b in zip(begin, end, strict=True)]


_COVER = "doc_id long, tag int, begin long, end long"


def covered(docs: DataFrame, *, length: int = LENGTH, prefix: int = PREFIX, crowd: int = CROWD) -> DataFrame:
    """Spans of ``docs`` (of ``identified``) that repeated windows cover; they may overlap."""
    suffixes = cut(_suffixes(docs, length, prefix), "suffixes")
    often = suffixes.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    kept = cut(suffixes.join(cut(often, "keys"), "key"), "kept")
    spans = kept.groupBy("key", "span").agg(
        F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("u"), "doc_id", "tag", "first", "more")).alias("at")
    )
    spans = cut(spans, "spans")
    # equal rows shrink to almost nothing in a file, so one reader may hold most of a hot span:
    # dealt out first, a hot span comes from all tasks and the join can split it
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = kept.repartition(parts).join(spans.filter("n > 1").select("key", "span"), ["key", "span"])
    whole = whole.select("doc_id", "tag", F.col("first").alias("begin"), (F.col("first") + F.col("more") + length).alias("end"))

    crowds = cut(spans.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "crowds")
    lone = spans.join(crowds, "key").select("key", "n", "m", "at.doc_id", "at.tag", "at.first", "at.more")
    wanted = lone.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("key", "n", "m", "first", "more")).alias("runs"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lead", "key", "n", "m", "doc_id", "tag", "first", "before", "after", "more"]
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32()]
        for batch in text_slices(batches):
            rows = []
            for doc_id, tag, text, wants in zip(*(batch[c].to_pylist() for c in ("doc_id", "tag", "text", "runs")), strict=True):
                data = text.encode()
                for w in wants:
                    first, more = w["first"], w["more"]
                    # the suffix: where the run's last window's first gram of this hash lies
                    piece = np.frombuffer(data[first + more : first + length + prefix], np.uint8)[:length]
                    grams = _gram_hashes(_prefix_sums(piece), prefix)
                    at = first + more + int(np.argmin(grams))
                    after = data[at : first + more + length]
                    rows.append((after[:LEAD], w["key"], w["n"], w["m"], doc_id, tag, first, data[first:at], after, more))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    texts = docs.join(wanted, same_doc(docs, wanted)).select(docs["doc_id"], docs["tag"], "text", "runs")
    fetched = texts.mapInArrow(
        fetch, "lead binary, key long, n long, m long, doc_id long, tag int, first long, before binary, after binary, more int"
    )
    fetched = cut(fetched.dropDuplicates(["key", "doc_id", "tag", "first"]), "fetched")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def settle() -> list[tuple]:
            if len(held) < 2:
                return []
            hits = repeated_windows([r["before"] for r in held], [r["after"] for r in held], [r["more"] for r in held], length)
            return [
                (r["doc_id"], r["tag"], a, b)
                for r, hit in zip(held, hits, strict=True)
                if r["n"] == 1
                for a, b in _intervals(r["first"], hit, length)
            ]

        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["key"] != key:
                    if len(held) >= crowd:  # whole groups only
                        rows += settle()
                        held = []
                    key = r["key"]
                held.append(r)
            if rows:
                yield _cover_batch(rows)
        if rows := settle():
            yield _cover_batch(rows)

    small = fetched.filter(F.col("m") <= crowd).repartitionByRange("lead", "key").sortWithinPartitions("lead", "key")
    small = small.mapInArrow(compare, _COVER)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                data = np.frombuffer(r["before"] + r["after"], np.uint8)
                hashes = _gram_hashes(_prefix_sums(data), length)
                n = len(hashes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), pa.array([r["n"]] * n, pa.int64()), pa.array([r["doc_id"]] * n, pa.int64())]
                    + [pa.array([r["tag"]] * n, pa.int32()), pa.array([r["first"]] * n, pa.int64()), pa.array(r["first"] + np.arange(n))],
                    names=["window", "n", "doc_id", "tag", "first", "begin"],
                )

    dealt = fetched.filter(F.col("m") > crowd).mapInArrow(windows, "window long, n long, doc_id long, tag int, first long, begin long")
    dealt = cut(dealt, "windows")
    again = cut(dealt.groupBy("window").agg(F.count("*").alias("c")).filter("c > 1").select("window"), "again")
    crowded = dealt.join(again, "window").filter("n = 1")
    # neighbours within a span merge here, so a long text collects few spans
    place = F.row_number().over(Window.partitionBy("doc_id", "tag", "first").orderBy("begin"))
    islands = crowded.withColumn("island", F.col("begin") - place).groupBy("doc_id", "tag", "first", "island").agg(F.min("begin").alias("begin"), F.max("begin").alias("last"))
    crowded = islands.select("doc_id", "tag", "begin", (F.col("last") + length).alias("end"))
    return whole.unionByName(small).unionByName(crowded)


def _cover_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "tag", "begin", "end"])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def suffix_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, prefix: int = PREFIX, crowd: int = CROWD) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` of every row: the removed runs and what is left, as bytes."""
    rows = identified(docs, id_col, text_col)
    cover = covered(rows, length=length, prefix=prefix, crowd=crowd)
    cover = cover.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("begin", "end")).alias("cover"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for batch in text_slices(batches):
            sizes, gone, left = [], [], []
            for text, cover in zip(batch["text"].to_pylist(), batch["cover"].to_pylist(), strict=True):
                data = text.encode()
                cuts = merged([(c["begin"], c["end"]) for c in cover or ()])
                edges = [0, *(x for c in cuts for x in c), len(data)]
                left.append(b"".join(data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
                gone.append([{"begin": a, "end": b} for a, b in cuts])
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(gone, span), pa.array(left, pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"],
            )

    joined = rows.join(cover, same_doc(rows, cover), "left").select(rows["doc_id"], "text", "cover")
    return joined.mapInArrow(remove, "doc_id long, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary")


def op1(docs: DataFrame) -> DataFrame:
    found = suffix_dedup(docs)
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        # a cut may part a character: what is not whole is replaced here, and only here
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
    )
