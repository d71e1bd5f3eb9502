"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame operations only.

Words are what white space and ASCII punctuation part, lower-cased; a shingle is
five successive words (all of them in an item of fewer).  A window of a document
has as many words as the item (or all, if the document has fewer).  A document
contains an item if some window's weighted shingle similarity, the sum of least
counts over the sum of greatest counts, is ``SIMILARITY`` = 0.8 or more.

1. *Starts.*  Such a window holds at least 0.8 of the item's shingles.  So the
   document shares one of any fifth of them and one more: the search joins on those
   that fewest items hold.  Of the pairs found, only documents that share 0.8 of the
   item's shingles are windowed.  Sliding a window right to the next shared shingle
   loses none, so windows start at shared shingles alone, or end with the text, and
   hold 0.8 of the item's shingles themselves.  Nothing is lost by this.
2. *Fingerprints.*  Every window gets a 64-bit SimHash of its shingles, summed two
   bits to a long in hash aggregation.
3. *Multi-index blocks.*  Two fingerprints within ``RADIUS`` = 24 bits differ in at
   most three bits of one of the eight 8-bit blocks.  The item's blocks are indexed
   with all values within three bits, so every window within the radius joins.
   Windows at similarity 0.8 differ in about 10 bits (deviation 3).
4. *Verification.*  The joined windows' exact similarity decides.

Null texts and texts or items without words match nothing.  Null ids are kept.
Rows equal in id and text give one row an item.  Ties go to the smaller start.
Empty tables give no rows.  Columns besides the id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, cut, identified, same_doc

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 24
BLOCKS = 8
_WITHIN = [v for v in range(256) if v.bit_count() <= RADIUS // BLOCKS]
_LANES = (1 << 32) | 1


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\s\p{Punct}]+"), lambda w: w != "")


def _hashes(words: str, k: int) -> Column:
    """Hashes of the shingles of ``k`` words; none where there are fewer words."""
    return F.slice(
        F.transform(words, lambda _, i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])),
        F.lit(1),
        F.greatest(F.size(words) - (k - 1), F.lit(0)),
    )


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item_id, item_words, k, item_n, hashes`` of every item with words."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), _words(F.col(text_col).cast("string")).alias("w"))
    rows = rows.filter(F.size("w") > 0).distinct().withColumn("k", F.least(F.size("w"), F.lit(SHINGLE)))
    hashes = F.coalesce(*[F.when(F.col("k") == k, _hashes("w", k)) for k in range(1, SHINGLE + 1)])
    rows = rows.withColumn("hashes", hashes)
    return rows.select("item_id", F.xxhash64("w").alias("variant"), F.size("w").alias("item_words"), "k", F.size("hashes").alias("item_n"), "hashes")


def _rarest(known: DataFrame, item: list[str]) -> DataFrame:
    """Of every item the shingles of which a document must share one to share 0.8 of them.

    They are those that fewest items hold: one lies among any that outnumber what may be missing.
    """
    held = known.groupBy("k", "h").agg(F.count("*").alias("held"))
    before = Window.partitionBy(*item).orderBy("held", "h").rowsBetween(Window.unboundedPreceding, -1)
    placed = known.join(held, ["k", "h"]).withColumn("before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    may_miss = F.col("item_n") - F.ceil(SIMILARITY * F.col("item_n") - 1e-9)
    return placed.filter(F.col("before") <= may_miss).select(*item, "k", "h")


def _fingerprint(shingles: DataFrame, keys: list[str]) -> DataFrame:
    """SimHash of the ``h`` rows of each key: two bit counts share each of 32 sums."""
    sums = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(_LANES))).alias(f"s{i}") for i in range(32)]
    counts = shingles.groupBy(*keys).agg(F.count("*").alias("n"), *sums)
    bits = F.lit(0).cast("long")
    for i in range(32):
        low, high = F.col(f"s{i}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(f"s{i}", 32)
        top = 1 << (i + 32)
        bits = bits.bitwiseOR(F.when(low * 2 > F.col("n"), F.lit(1 << i)).otherwise(F.lit(0).cast("long")))
        bits = bits.bitwiseOR(F.when(high * 2 > F.col("n"), F.lit(top - (1 << 64) if i == 31 else top)).otherwise(F.lit(0).cast("long")))
    return counts.select(*keys, "n", bits.alias("fp"))


def _block(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255)).cast("int")


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``doc_id, tag, item_id, start, similarity, distance``: each document's best window on each item."""
    rows = identified(docs, id_col, text_col)
    items = cut(_items(benchmark, item_id, item_text), "items")
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum("item_n"), F.lit(0)).alias("s"), F.collect_set("k").alias("k")).head()
    item = ["item_id", "variant"]
    sizes = [*item, "item_words", "k", "item_n"]
    known = items.select(*sizes, F.explode("hashes").alias("h")).groupBy(*sizes, "h").agg(F.count("*").alias("weight"))
    known = cut(known, "shingles")
    rarest = cut(_rarest(known, item), "rarest")
    n_rarest = rarest.count()

    pairs = None
    words = rows.select("doc_id", "tag", _words(F.col("text")).alias("w"))
    for k in sorted(size.k):  # five at most, and one where no item is shorter than a shingle
        # a document with fewer words than a shingle has one shingle of all its words, which no longer item has
        each = words.select("doc_id", "tag", F.explode(_hashes("w", k)).alias("h"))
        each = each.join(bounded(rarest.filter(F.col("k") == k).drop("k"), n_rarest, 32), "h").drop("h")
        pairs = each if pairs is None else pairs.unionByName(each)
    if pairs is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, tag int, item_id long, start int, similarity double, distance int")
    one_doc = ["doc_id", "tag", *item]
    pairs = cut(pairs.distinct(), "candidates")
    asked = cut(pairs.groupBy("doc_id", "tag").agg(F.collect_list(F.struct(*item)).alias("asked")), "asked")
    few = bounded(asked, asked.count() + pairs.count(), 40)
    texts = rows.join(few, same_doc(rows, asked)).select(rows["doc_id"], rows["tag"], "text", "asked")
    texts = texts.dropDuplicates(["doc_id", "tag"])  # repeated rows: one is enough
    texts = texts.select("doc_id", "tag", "asked", _words(F.col("text")).alias("w"))
    held = None
    for k in sorted(size.k):
        one = texts.select("doc_id", "tag", "asked", F.lit(k).alias("k"), F.size("w").alias("n_words"), _hashes("w", k).alias("hashes"))
        held = one if held is None else held.unionByName(one)
    held = cut(held, "held")

    at = held.select("doc_id", "tag", "asked", "n_words", F.col("k").alias("in_k"), F.posexplode("hashes").alias("at", "in_h"))
    is_asked = F.exists("asked", lambda a: a["item_id"].eqNullSafe(F.col("item_id")) & (a["variant"] == F.col("variant")))
    hits = at.join(bounded(known.drop("weight"), size.s, 64), (F.col("in_h") == F.col("h")) & (F.col("in_k") == F.col("k")) & is_asked)
    hits = hits.groupBy(*one_doc, "n_words", "item_words", "k", "item_n").agg(F.collect_list("at").alias("ats"))
    # a window that shares too few positions with the item is not similar enough, whatever their weights
    need = F.ceil(SIMILARITY * F.col("item_n") - 1e-9).cast("int")
    hits = hits.filter(F.size("ats") >= need).withColumn("ats", F.array_sort("ats")).withColumn("need", need)
    hits = hits.withColumn("last", F.greatest(F.lit(0), F.col("n_words") - F.col("item_words")))
    full = F.transform("ats", lambda x, i: F.when((x <= F.col("last")) & (F.get("ats", i + F.col("need") - 1) < x + F.col("item_n")), x))
    end = F.when(F.size(F.filter("ats", lambda x: x >= F.col("last"))) >= F.col("need"), F.col("last"))
    start = F.explode(F.array_distinct(F.array_compact(F.concat(full, F.array(end))))).alias("start")
    starts = cut(hits.select(*one_doc, "k", "item_n", start), "starts")
    of = held.select(F.col("doc_id").alias("of_doc"), F.col("tag").alias("of_tag"), F.col("k").alias("of_k"), "hashes")
    on = F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("tag") == F.col("of_tag")) & (F.col("k") == F.col("of_k"))
    windows = starts.join(of, on).select(*one_doc, "k", "item_n", "start", F.expr("slice(hashes, start + 1, item_n)").alias("hs"))
    windows = cut(windows, "windows")

    window = [*one_doc, "start"]
    prints = _fingerprint(windows.select(*window, F.explode("hs").alias("h")), window)
    item_prints = _fingerprint(items.select(*item, F.explode("hashes").alias("h")), item)
    item_prints = item_prints.select(*item, F.col("n").alias("item_n"), F.col("fp").alias("item_fp"))
    index = F.explode(F.array(*[F.struct(F.lit(i).alias("block"), _block(F.col("item_fp"), i).alias("v")) for i in range(BLOCKS)]))
    index = item_prints.select(*item, "item_fp", "item_n", index.alias("b"))
    index = index.select(*item, "item_fp", "item_n", "b.block", F.explode(F.array(*[F.lit(x) for x in _WITHIN])).alias("x"), "b.v")
    index = index.select(*item, "item_fp", "item_n", "block", F.col("v").bitwiseXOR(F.col("x")).alias("value"))
    index = bounded(index, size.n * BLOCKS * len(_WITHIN), 48)
    blocks = F.explode(F.array(*[F.struct(F.lit(i).alias("block"), _block(F.col("fp"), i).alias("value")) for i in range(BLOCKS)]))
    probes = prints.select(*window, "n", "fp", blocks.alias("b")).select(*window, "n", "fp", "b.*")
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    index = index.select(*[F.col(c).alias(f"of_{c}") for c in (*item, "block", "value")], "item_fp", "item_n")
    on = F.col("item_id").eqNullSafe(F.col("of_item_id"))
    for c in ("variant", "block", "value"):
        on = on & (F.col(c) == F.col(f"of_{c}"))
    near = probes.join(index, on).withColumn("distance", distance).filter(F.col("distance") <= RADIUS)
    near = cut(near.select(*window, "n", "item_n", "distance").distinct(), "near")

    pick = near.select(*[F.col(c).alias(f"near_{c}") for c in window], F.col("n").alias("near_n"), F.col("item_n").alias("near_item_n"), "distance")
    on = F.lit(True)
    for c in window:
        on = on & F.col(c).eqNullSafe(F.col(f"near_{c}"))
    found = windows.select(*window, "hs").join(pick, on).select(*window, "near_n", "near_item_n", "distance", F.explode("hs").alias("h"))
    counts = found.groupBy(*window, "near_n", "near_item_n", "distance", "h").agg(F.count("*").alias("c"))
    weights = bounded(known.select(*[F.col(c).alias(f"of_{c}") for c in (*item, "h")], "weight"), size.s, 48)
    on = (F.col("h") == F.col("of_h")) & F.col("item_id").eqNullSafe(F.col("of_item_id")) & (F.col("variant") == F.col("of_variant"))
    shared = counts.join(weights, on).groupBy(*window, "near_n", "near_item_n", "distance").agg(F.sum(F.least("c", "weight")).alias("m"))
    similar = shared.withColumn("similarity", F.col("m") / (F.col("near_n") + F.col("near_item_n") - F.col("m")))
    best = F.max_by(F.struct("start", "similarity", "distance"), F.struct("similarity", -F.col("start")))
    similar = similar.filter(F.col("similarity") >= SIMILARITY).groupBy("doc_id", "tag", "item_id").agg(best.alias("b"))
    return similar.select("doc_id", "tag", "item_id", "b.start", "b.similarity", "b.distance")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that contain a benchmark item; all columns are as they were."""
    leaks = cut(contaminated(docs, benchmark).select("doc_id", "tag").distinct(), "leaks")
    rows = identified(docs, rest=True)
    few = bounded(leaks, leaks.count(), 24)
    return rows.join(few, same_doc(rows, leaks), "left_anti").select("rest.*")


def op10(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contaminated(docs, benchmark).select("doc_id", "item_id", "start", "similarity")


_SQL_WORDS = "[x FOR x IN regexp_split_to_array(lower({}), '[\\s!-/:-@\\[-`{{-~]+') IF x <> '']"
ORACLE = f"""
WITH dw AS (SELECT doc_id, {_SQL_WORDS.format("text")} AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, {_SQL_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
items AS (SELECT item_id, w, len(w) AS item_words, greatest(len(w) - 4, 1) AS item_n FROM iw WHERE len(w) > 0),
ish AS (SELECT item_id, array_to_string(list_slice(w, p, p + 4), ' ') AS s, count(*) AS c
        FROM (SELECT item_id, w, unnest(generate_series(1, item_n)) AS p FROM items) GROUP BY 1, 2),
dsh AS (SELECT doc_id, p - 1 AS pos, n_words, array_to_string(list_slice(w, p, p + 4), ' ') AS s
        FROM (SELECT doc_id, w, len(w) AS n_words, unnest(generate_series(1, len(w) - 4)) AS p FROM dw)),
starts AS (SELECT DISTINCT d.doc_id, i.item_id, greatest(0, least(d.pos, d.n_words - t.item_words)) AS start, t.item_n
           FROM dsh d JOIN ish i ON d.s = i.s JOIN items t ON t.item_id = i.item_id),
counts AS (SELECT a.doc_id, a.item_id, a.start, a.item_n, d.s, count(*) AS c
           FROM starts a JOIN dsh d ON d.doc_id = a.doc_id AND d.pos >= a.start AND d.pos < a.start + a.item_n
           GROUP BY 1, 2, 3, 4, 5),
sims AS (SELECT c.doc_id, c.item_id, c.start, c.item_n, sum(c.c) AS n, coalesce(sum(least(c.c, i.c)), 0) AS m
         FROM counts c LEFT JOIN ish i ON i.item_id = c.item_id AND i.s = c.s GROUP BY 1, 2, 3, 4),
best AS (SELECT doc_id, item_id, start, CAST(m AS DOUBLE) / CAST(n + item_n - m AS DOUBLE) AS similarity FROM sims)
SELECT doc_id, item_id, CAST(min(start) AS INTEGER) AS start, similarity FROM (
  SELECT *, max(similarity) OVER (PARTITION BY doc_id, item_id) AS most FROM best)
WHERE similarity = most AND similarity >= 0.8 GROUP BY doc_id, item_id, similarity
"""
