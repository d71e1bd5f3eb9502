"""Near-duplicate groups by SimHash and exact shingle similarity: all pairs at 0.8 or more.

Words and shingles are those of ``simhash``, with five words to a shingle; a text is
the set of its shingles' hashes.  Two texts are similar if they share 0.8 or more of
the union.  Equal sets fold into one class first.

1. *Fingerprints.*  Sets whose fingerprints link by pigeonhole blocks, within three
   bits, are verified exactly and joined into groups.  Many similar pairs differ in more
   bits than blocks can index, so the steps below find all those that are still apart.
2. *Prefixes.*  Shingles are ordered by how often a sample of texts holds them, then by
   hash; the order only decides how many candidates there are.  A set's prefix is its
   first ``n // 5 + 1``.  Of two similar sets, that whose prefix ends first keeps all but
   ``n`` less its prefix of what they share in it, and so in both prefixes.
3. *Rarest shared shingle.*  That many shared shingles follow the one that fewest prefixes
   hold.  A pair is a candidate only at a shingle after which both sets have as many that
   other sets hold; shingles of a passage that many texts share seldom are such.  Shingles
   that the same prefixes hold, such as a passage's, fold into the first of them, which
   makes a pair a candidate if any of them does.
4. *Hubs.*  Each set in a crowded key is first checked against a few others, that with
   fewest shingles of its own and those of the smallest hashes; pairs in one group by then
   need no check, and of each key only those outside its largest group meet its others.
   No link between groups is lost.
5. *Parities.*  A set has as many bits as shingles at least, each the parity of its
   shingles there.  Two sets' bits differ in no more places than the sets do, so pairs of
   texts that share a passage alone are told apart where they meet, by the whole sets.
6. *Verification.*  The sets' exact similarity decides.

Hash collisions (64 bits) are the only approximation.  Null text has no words; texts
without words are one class.  Null ids and repeated rows are as in ``simhash``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, cut, identified, same_doc, text_slices
from .components import components
from .simhash import SEED, fingerprint_of, firsts, shingle_hashes
from .simhash import links as fingerprint_links

SHINGLE = 5
#: Texts whose shingles are counted for the order, and the count from which it matters.
SAMPLE = 16_384
OFTEN = 3
#: Entries of the order that are sent to the tasks.
RANKED = 50_000
#: Members of a key from which it is crowded.
CROWD = 8
#: Hubs that a set is checked against in a round, and rounds at most; they end where few sets still join.
HUBS, ROUNDS = 4, 4


def _similar(shared: Column, a: Column, b: Column) -> Column:
    """Whether sets of ``a`` and ``b`` sharing so many have a similarity of 0.8."""
    return shared * 9 >= (a + b) * 4


def _candidate(a: str, b: str) -> Column:
    """Whether two sets' sizes, and what follows a shared shingle in both, allow for a similarity of 0.8."""
    n = [F.col(f"n_{x}") for x in (a, b)]
    out = [x - F.floor(x / 5) - 1 for x in n]
    least = F.ceil((n[0] + n[1]) * 4 / 9 - 1e-9) - F.greatest(*out)
    return (n[0] * 5 >= n[1] * 4) & (n[1] * 5 >= n[0] * 4) & (F.least(f"left_{a}", f"left_{b}") + 1 >= least)


def _parities(hashes: np.ndarray) -> np.ndarray:
    """A power of two of bits, as many as hashes at least: how often each is hit, modulo two."""
    size = 64 << max(0, (max(len(hashes), 1) - 1).bit_length() - 6)
    hit = np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(hit.astype(np.uint8), bitorder="little").view("<i8")


def _folded(x: Column, y: Column) -> Column:
    """Parities ``x`` in the places of ``y``, which has as many or half as many."""
    half = F.size(y)
    both = F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))
    return F.when(F.size(x) > half, both).otherwise(x)


def _near(a: str, b: str) -> Column:
    """Whether two sets' parities differ in no more places than sets of a similarity of 0.8 do.

    Sizes that allow for it are within a quarter, so the longer parities are at most twice as long.
    """
    x, y = F.col(f"odd_{a}"), F.col(f"odd_{b}")
    apart = F.zip_with(_folded(x, y), _folded(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(apart, F.lit(0), lambda n, more: n + more) * 9 <= F.col(f"n_{a}") + F.col(f"n_{b}")


def _ranks(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles of a sample, sorted, and their counts."""
    total, parts = rows.count(), 1 << 20
    share = min(parts, max(1, round(SAMPLE / max(total, 1) * parts)))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            each = [np.unique(np.array(shingle_hashes(t, SHINGLE), np.uint64)) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(each).view(np.int64))], names=["h"])

    some = rows.filter(F.pmod(F.xxhash64("doc_id", "tag"), F.lit(parts)) < share)
    counts = some.select("text").mapInArrow(emit, "h long").groupBy("h").agg(F.count("*").alias("n"))
    top = counts.filter(F.col("n") >= OFTEN).orderBy(F.desc("n"), "h").limit(RANKED).toArrow()
    hashes, often = top["h"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], often[order]


def prefixes(docs: DataFrame) -> DataFrame:
    """``doc_id, tag, set, fp, n, first, odd`` of every row: the set's name, fingerprint, size, first fifth and one more, and parities.

    ``docs`` is of ``identified``.  Whole sets are made anew for the few that are verified.
    """
    known, often = _ranks(docs)

    def ordered(text: str) -> tuple[int, int, int, np.ndarray, np.ndarray]:
        every = shingle_hashes(text, SHINGLE)
        name, hashes = _shingle_set(every)
        n, odd = len(hashes), _parities(hashes)
        if len(known) and n:
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hashes = hashes[np.argsort(np.where(known[at] == hashes, often[at], 0), kind="stable")]
        return name, fingerprint_of(every), n, hashes[: n // 5 + 1].view(np.int64), odd

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            found = [ordered(t) for t in batch["text"].to_pylist()]
            made = [pa.array(np.array([f[i] for f in found], np.uint64).view(np.int64)) for i in (0, 1)]
            made += [pa.array([f[2] for f in found], pa.int32()), *(_lists([f[i] for f in found]) for i in (3, 4))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["tag"], *made], names=["doc_id", "tag", "set", "fp", "n", "first", "odd"])

    return cut(docs.mapInArrow(emit, "doc_id long, tag int, set long, fp long, n int, first array<long>, odd array<long>"), "prefixes")


def _shingle_set(every: list[int]) -> tuple[int, np.ndarray]:
    """Name and sorted members of the set of a text's shingle hashes."""
    import xxhash

    hashes = np.unique(np.array(every, np.uint64))
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED), hashes


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def _whole(docs: DataFrame, holders: DataFrame, asked: DataFrame) -> DataFrame:
    """``set, hashes`` of the sets asked for, made from the text of one document each."""
    wanted = cut(holders.join(asked, "set", "left_semi"), "wanted")
    few = bounded(wanted, wanted.count(), 32)
    texts = docs.join(few, same_doc(docs, wanted)).select(wanted["set"], "text")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            found = [_shingle_set(shingle_hashes(t, SHINGLE))[1].view(np.int64) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["set"], _lists(found)], names=["set", "hashes"])

    # rows equal in id and text hold one set several times
    return cut(texts.mapInArrow(emit, "set long, hashes array<long>").dropDuplicates(["set"]), "whole")


def _verified(pairs: DataFrame, docs: DataFrame, holders: DataFrame) -> DataFrame:
    """Those of ``pairs`` (``a, b``) whose sets are similar."""
    pairs = cut(pairs.distinct(), "pairs")
    asked = pairs.select(F.col("a").alias("set")).unionAll(pairs.select(F.col("b").alias("set"))).distinct()
    held = _whole(docs, holders, asked)
    both = pairs.join(held.select(F.col("set").alias("a"), F.col("hashes").alias("x")), "a")
    both = both.join(held.select(F.col("set").alias("b"), F.col("hashes").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return cut(both.filter(_similar(shared, F.size("x"), F.size("y"))).select("a", "b"), "links")


def _grouped(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with the group that each set is in so far."""
    known = cut(components(links), "groups")
    joined = rows.join(known.withColumnRenamed("node", "set"), "set", "left")
    return cut(joined.withColumn("group", F.coalesce("component", "set")).drop("component"), "grouped")


def _close(found: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of sets that connect those whose fingerprints link."""
    prints = cut(found.select("fp", "set").distinct(), "prints")
    classes = cut(prints.groupBy("fp").agg(F.min("set").alias("least")), "print-classes")
    linked = fingerprint_links(classes.select("fp"))
    ends = [classes.select(F.col("fp").alias(c), F.col("least").alias(f"set_{c}")) for c in "ab"]
    across = linked.join(ends[0], "a").join(ends[1], "b").select(F.col("set_a").alias("x"), F.col("set_b").alias("y"))
    within = prints.join(classes, "fp").select(F.col("least").alias("x"), F.col("set").alias("y"))
    pairs = across.unionAll(within).filter("x != y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def links(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Edges ``a, b`` between sets that join all sets of a similarity of 0.8 or more.

    ``found`` are the ``prefixes`` of ``docs``.
    """
    holder = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "tag")).alias("d")
    holders = found.groupBy("set").agg(holder, F.count("*").alias("held"))
    holders = cut(holders.select("set", "d.doc_id", "d.tag", "held"), "holders")
    # copies count once: all but a set's first document go, which are few enough to send or are joined
    copied = holders.filter("held > 1").select(F.col("set").alias("of"), F.col("doc_id").alias("first_doc"), F.col("tag").alias("first_tag"))
    copies = found.select("doc_id", "tag", "set").join(copied, F.col("set") == F.col("of"))
    same = F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("tag") == F.col("first_tag"))
    copies = cut(copies.filter(~same).select("doc_id", "tag").distinct(), "copies")
    holders = holders.drop("held")
    one = found.join(bounded(copies, copies.count(), 64), same_doc(found, copies), "left_anti").select("set", "n", "first", "odd")
    in_prefix = one.select("set", "n", F.explode("first").alias("h"))
    # sums, as rows equal in id and text hold one set several times; of 32 bits, which never overflow
    sums = [F.sum(F.hash("set").cast("long")).alias("sum"), F.sum(F.shiftright(F.xxhash64("set"), 32)).alias("other")]
    keys = in_prefix.groupBy("h").agg(F.count("*").alias("held"), F.min("set").alias("least"), *sums)
    keys = cut(keys.filter("held > 1"), "keys")
    # shingles that the same sets hold: the first of them in the order below stands for all
    folded = keys.groupBy("held", "least", "sum", "other").agg(F.min("h").alias("h")).select("h", F.lit(True).alias("stands"))
    keys = cut(keys.select("h", "held").join(folded, "h", "left"), "folded")
    rows = in_prefix.join(bounded(keys, keys.count(), 32), "h")
    # of the prefix's shingles that others hold, how many are held by more of them; and those no other holds
    left = F.row_number().over(Window.partitionBy("set").orderBy(F.desc("held"), F.desc("h"))) - 1
    own = F.floor(F.col("n") / 5) + 1 - F.count("*").over(Window.partitionBy("set"))
    rows = cut(rows.withColumn("left", left).withColumn("own", own).filter("stands").drop("stands"), "keyed")

    joined = _verified(_close(found), docs, holders)
    now, n_sets = _grouped(rows, joined), holders.count()
    for turn in range(ROUNDS):
        crowded = now.filter(F.col("held") > CROWD)
        # the plainest member is likely what the others are copies of; the rest are any
        orders = [F.struct((F.col("own") * int(i == 0)).alias("own"), F.xxhash64("set", F.lit(turn * HUBS + i)).alias("any")) for i in range(HUBS)]
        member = [*(F.col(c).alias(f"{c}_b") for c in ("set", "n", "left", "group"))]
        hubs = [F.struct(F.lit(i).alias("nth"), F.min(F.struct(o.alias("order"), *member)).alias("hub")) for i, o in enumerate(orders)]
        hubs = cut(crowded.groupBy("h").agg(F.array(*hubs).alias("hubs")).select("h", F.inline("hubs")), "hubs").select("h", "nth", "hub.*")
        met = crowded.select("h", *[F.col(c).alias(f"{c}_a") for c in ("set", "n", "left", "group")]).join(hubs, "h")
        met = met.filter((F.col("group_a") != F.col("group_b")) & _candidate("a", "b"))
        met = met.groupBy("set_a", "nth").agg(F.min(F.struct("order", "set_b")).alias("hub")).select("set_a", F.col("hub.set_b").alias("set_b"))
        more = _verified(met.select(F.least("set_a", "set_b").alias("a"), F.greatest("set_a", "set_b").alias("b")), docs, holders)
        joined = joined.unionAll(more)
        if more.count() * 200 < n_sets:  # so few that another grouping costs more than the pairs it spares
            break
        now = _grouped(rows, joined)

    of_key = now.groupBy("h", "group").agg(F.count("*").alias("c")).groupBy("h")
    of_key = cut(of_key.agg(F.count("*").alias("groups"), F.max(F.struct("c", "group")).alias("most")).filter("groups > 1"), "mixed")
    now = cut(now.join(of_key.select("h", F.col("most.group").alias("most")), "h"), "apart")
    odd = one.select("set", "odd").join(now.select("set").distinct(), "set", "left_semi").dropDuplicates(["set"])
    now = now.join(odd, "set")
    few, every = (now.select("h", "most", *[F.col(c).alias(f"{c}_{side}") for c in ("set", "n", "left", "group", "odd")]) for side in "ab")
    few, every = few.filter(F.col("group_a") != F.col("most")).drop("most"), every
    once = (F.col("group_b") == F.col("most")) | (F.col("set_a") < F.col("set_b"))
    pairs = few.join(every, "h").filter((F.col("group_a") != F.col("group_b")) & once & _candidate("a", "b") & _near("a", "b"))
    last = _verified(pairs.select(F.least("set_a", "set_b").alias("a"), F.greatest("set_a", "set_b").alias("b")), docs, holders)
    return joined.unionAll(last)


def similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, tag, component`` of every row; ``component`` names the group by a set."""
    rows = identified(docs, id_col, text_col)
    found = prefixes(rows)
    joined = cut(components(links(rows, found)), "components")
    known = found.select("doc_id", "tag", "set").join(joined.withColumnRenamed("node", "set"), "set", "left")
    return known.select("doc_id", "tag", F.coalesce("component", "set").alias("component"))


def without_similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group: that of the smallest id, nulls last."""
    return firsts(docs, cut(similar(docs, id_col=id_col, text_col=text_col), "near"), id_col=id_col, text_col=text_col)
