"""SimHash fingerprints and near-duplicate components by pigeonhole blocks.

A-Z are lowered in whole texts; words are runs of non-white-space bytes; a
shingle is three successive words joined by blanks, repeats counted, or all the
words where there are fewer; no words: fingerprint zero.  A bit of the
fingerprint is set if it is set in over half of the shingles' XXH64 (seed 42).

Fingerprints link at ``RADIUS`` = 3 or fewer differing bits.  Equal fingerprints
fold into one class first.  The 64 bits are split into ``BLOCKS`` = 6; three
differing bits leave at least three blocks alike, so every link shares the key
of one of the 20 block triples.  Keys held by one fingerprint go.  The members
of a key are sorted, and compared bitwise in vectorised blocks with a union-find
that emits a spanning forest, never all pairs.  A key with more than ``crowd``
members is settled through hubs instead: a fingerprint one bit away at most from
a hub links with all that are two bits away at most from it, and every pair
within three bits has such a hub.  That is linear in the members and spread over
all tasks, so nothing is left out.

Null text has no words.  Null ids are fingerprinted but can't name a component;
one holding only such rows has a null component.  Repeated rows all return.  An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, identified, same_doc, text_slices
from .components import components

RADIUS = 3
BLOCKS = 6
SHINGLE = 3
SEED = 42
#: Fingerprints on one key up to which a task compares them bit by bit.
CROWD = 4096

_EDGES = [round(i * 64 / BLOCKS) for i in range(BLOCKS + 1)]
_MASKS = [((1 << (_EDGES[i + 1] - _EDGES[i])) - 1) << _EDGES[i] for i in range(BLOCKS)]
KEY_MASKS = [sum(_MASKS[i] for i in c) for c in combinations(range(BLOCKS), BLOCKS - RADIUS)]
_UPPER = bytes(range(256)).lower()


def shingle_hashes(text: str, n: int = SHINGLE) -> list[int]:
    import xxhash

    words = text.encode().translate(_UPPER).split()
    if not words:
        return []
    if len(words) <= n:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    begins = np.append(0, ends[:-1])[: len(words) - n + 1].tolist()
    stops = (ends[n - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(begins, stops, strict=True)]


def fingerprint(text: str) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    return fingerprint_of(shingle_hashes(text))


def fingerprint_of(hashes: list[int]) -> int:
    """The fingerprint of shingles by their hashes, repeats counted."""
    if not hashes:
        return 0
    set_in = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = np.array(hashes[at : at + (1 << 14)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        set_in += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, tag, fp`` (the fingerprint's bits as a long) of every row."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            fps = np.array([fingerprint(t) for t in batch["text"].to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["tag"], pa.array(fps.view(np.int64))], names=["doc_id", "tag", "fp"])

    rows = identified(docs, id_col, text_col)
    return cut(rows.mapInArrow(emit, "doc_id long, tag int, fp long"), "fingerprints")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Spanning forest of the links among distinct fingerprints."""
    n = len(fps)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    bits, out = fps.view(np.uint64), []
    step = max(1, (1 << 20) // max(n, 1))
    for at in range(0, n, step):
        near = np.bitwise_count(bits[at : at + step, None] ^ bits[None, at + 1 :]) <= radius
        for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
            i, j = at + i, at + 1 + j
            if j > i and (a := find(i)) != (b := find(j)):
                root[b] = a
                out.append((int(fps[i]), int(fps[j])))
    return out


def links(distinct: DataFrame, *, crowd: int = CROWD) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints (column ``fp``) that span the link graph."""
    number = F.explode(F.array(*[F.lit(i) for i in range(len(KEY_MASKS))]))
    masks = F.array(*[F.lit(_signed(m)) for m in KEY_MASKS])
    keyed = distinct.select("fp", number.alias("k")).withColumn("part", F.col("fp").bitwiseAND(F.get(masks, F.col("k"))))
    keyed = keyed.withColumn("key", F.xxhash64("k", "part")).select("key", "fp")
    sizes = cut(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "keys")
    kept = cut(keyed.join(sizes, "key"), "keyed")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            found = []
            keys, fps = batch["key"].to_numpy(), batch["fp"].to_numpy()
            cuts = np.append(np.insert(np.flatnonzero(np.diff(keys)) + 1, 0, 0), len(keys))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if keys[a] != key:
                    found += forest(np.concatenate(held)) if held else []
                    key, held = keys[a], []
                held.append(fps[a:b])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])
        if held and (found := forest(np.concatenate(held))):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    small = kept.filter(F.col("n") <= crowd).select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
    small = small.mapInArrow(compare, "a long, b long")
    return small.unionByName(_hubs(kept.filter(F.col("n") > crowd).select("fp").distinct()))


def _hubs(crowded: DataFrame) -> DataFrame:
    """Links within three bits among many fingerprints, through points between them."""
    flips = [0, *(_signed(1 << i) for i in range(64))]
    twos = [*flips, *(_signed(1 << i | 1 << j) for i, j in combinations(range(64), 2))]
    one, two = (F.array(*[F.lit(x) for x in xs]) for xs in (flips, twos))
    hub = F.col("fp").bitwiseXOR(F.col("x")).alias("hub")
    near = crowded.select("fp", F.explode(one).alias("x")).select(hub, "fp")
    centre = cut(near.groupBy("hub").agg(F.min("fp").alias("a")), "hubs")
    far = crowded.select("fp", F.explode(two).alias("x")).select(hub, "fp")
    return far.join(centre, "hub").filter("a != fp").select("a", F.col("fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """``doc_id, tag, fp, component, component_id`` of every row.

    ``component`` names the component by a fingerprint, ``component_id`` by its smallest id.
    """
    rows = fingerprints(docs, id_col=id_col, text_col=text_col)
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    joined = cut(components(links(classes.select("fp"), crowd=crowd)), "components")
    known = classes.join(joined, classes["fp"] == joined["node"], "left")
    known = known.withColumn("component", F.coalesce("component", "fp")).select("fp", "least", "component")
    named = known.groupBy("component").agg(F.min("least").alias("component_id"))
    named = cut(known.join(named, "component").select("fp", "component", "component_id"), "named")
    return rows.join(named, "fp").select("doc_id", "tag", "fp", "component", "component_id")


def without_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, nulls last.

    Of rows equal in id and text one stays, whichever; all columns are as they were.
    """
    return firsts(docs, cut(near_duplicates(docs, id_col=id_col, text_col=text_col), "near"), id_col=id_col, text_col=text_col)


def firsts(docs: DataFrame, found: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first row of each component in ``found`` (``doc_id, tag, component`` of every row)."""
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "tag")
    first = found.groupBy("component").agg(F.min(place).alias("first"))
    first = cut(first.select("first.doc_id", "first.tag"), "first")
    rows = identified(docs, id_col, text_col, rest=True)
    kept = rows.join(first, same_doc(rows, first), "left_semi")
    if not found.groupBy("doc_id", "tag").count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "tag"])
    return kept.select("rest.*")


def op6(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
