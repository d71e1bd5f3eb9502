"""Harmonic packing of documents into fixed-capacity sequences.

A document of n ids gives whole sequences first; what is left is cut into the
powers of two from ``capacity/2`` down to ``least`` that sum to it, and a tail
under ``least`` stays in one piece.  A piece of length l belongs to the
reciprocal class k = capacity div l, (capacity/(k+1), capacity/k], and any k
pieces of a class fit one sequence.  Workers rank their own pieces; a prefix sum
over the counts of (bucket, class) gives each worker its first rank, so all fill
bins of exactly k pieces on their own.  Power-of-two pieces leave no padding.
Fewer than k pieces remain of each class, a number bounded by the capacity and
not by the corpus; those are packed together, largest first.

Null text is empty, so its document is the end id alone.  Repeated rows and
null ids are packed row by row.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, cut, identified, text_slices
from .encoding import default_tokenizer, encoder

CAPACITY = 2048
#: Tails shorter than this are not cut further.
LEAST = 64
PIECE = "doc_id long, doc_tokens long, start long, length long, ids_crc32 long, class int"


def cuts(n: int, capacity: int = CAPACITY, least: int = LEAST) -> list[int]:
    """Lengths of the pieces of a document of ``n`` ids, in order."""
    out, rest = [capacity] * (n // capacity), n % capacity
    size = capacity >> 1
    while size >= least:
        if rest >= size:
            out.append(size)
            rest -= size
        size >>= 1
    return out + [rest] if rest else out


def pieces(
    docs: DataFrame,
    *,
    tokenizer: str | None = None,
    end_id: int = 1,
    capacity: int = CAPACITY,
    least: int = LEAST,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every document's pieces with their class; ids themselves stay where they are."""
    tokenizer = tokenizer or default_tokenizer()
    end = np.array([end_id], "<u4").tobytes()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in text_slices(batches):
            cols: list[list] = [[] for _ in range(6)]
            ids_of = enc.encode(batch["text"].to_pylist())
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), ids_of, strict=True):
                ids += end
                n, at = len(ids) // 4, 0
                for size in cuts(n, capacity, least):
                    crc = zlib.crc32(ids[4 * at : 4 * (at + size)])
                    row = (doc_id, n, at, size, crc, capacity // size)
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                    at += size
            kinds = [pa.int64()] * 5 + [pa.int32()]
            arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "doc_tokens", "start", "length", "ids_crc32", "class"])

    found = identified(docs, id_col, text_col).select("doc_id", "text").mapInArrow(cut_up, PIECE)
    # the number holds the partition in its high bits: a bucket is what one worker made
    found = found.withColumn("piece", F.monotonically_increasing_id())
    return cut(found.withColumn("bucket", F.shiftright("piece", 33)), "pieces")


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces."""
    # a few rows a task: many small files would cost more than the counts themselves
    counts = cut(found.groupBy("class", "bucket").agg(F.count("*").alias("n")).coalesce(16), "class-counts")
    earlier = Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        "class",
        "bucket",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"),
        F.expr("sum(n) OVER (PARTITION BY class) div class").alias("bins"),
    )
    firsts = counts.select("class", "bins").distinct()
    firsts = firsts.select(
        "class",
        F.coalesce(
            F.sum("bins").over(Window.orderBy("class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("first"),
        F.sum("bins").over(Window.partitionBy(F.lit(1))).alias("all_bins"),
    )
    table = bounded(counts.join(F.broadcast(firsts), "class"), counts.count(), 64)  # a row a class and bucket
    local = Window.partitionBy("class", "bucket").orderBy("piece")
    ranked = found.withColumn("rank", F.row_number().over(local) - 1).join(table, ["class", "bucket"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("base")).withColumn("bin", F.expr("rank div class"))
    filled = ranked.filter("bin < bins").withColumn("sequence_id", F.col("first") + F.col("bin"))
    slot = Window.partitionBy("sequence_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    filled = filled.withColumn("offset", F.coalesce(F.sum("length").over(slot), F.lit(0)))

    def fit(left: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(["length", "piece"], ascending=[False, True])
        room: list[int] = []
        where, offset = [], []
        first_open = 0
        for size in left["length"].tolist():
            at = next((i for i in range(first_open, len(room)) if room[i] >= size), None)
            if at is None:
                at = len(room)
                room.append(capacity)
            where.append(at)
            offset.append(capacity - room[at])
            room[at] -= size
            while first_open < len(room) and not room[first_open]:
                first_open += 1
        left["sequence_id"] = left["all_bins"] + np.array(where, dtype=np.int64)
        left["offset"] = np.array(offset, dtype=np.int64)
        return left[names]

    names = ["doc_id", "doc_tokens", "start", "length", "ids_crc32", "sequence_id", "offset", "class"]
    rest = ranked.filter("bin >= bins").select("doc_id", "doc_tokens", "start", "length", "ids_crc32", "class", "piece", "all_bins")
    schema = "doc_id long, doc_tokens long, start long, length long, ids_crc32 long, sequence_id long, offset long, class int"
    # fewer than k pieces of each class k: bounded by the capacity, so one task is enough
    return filled.select(*names).unionByName(rest.groupBy().applyInPandas(fit, schema))


def op5(docs: DataFrame) -> DataFrame:
    return pack(pieces(docs)).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
