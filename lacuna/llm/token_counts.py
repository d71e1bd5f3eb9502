"""Token counts by separator scan of flat, unindexed token files.

A flat file is nothing but 16- or 32-bit ids; each document ends with the end
id, which no text can produce (special tokens' strings are ordinary text here).
Blocks of a file are scanned on their own with one vectorised search each; a
document that spans blocks is stitched by a prefix scan over the block tails.

Null and empty texts count the end id alone (1); repeated rows and null ids
count row by row; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, cut, fresh_path, identified, text_slices
from .encoding import default_tokenizer, encoder
from .token_files import open_store

#: Ids in a block.
BLOCK_IDS = 1 << 20
#: Blocks that a task scans at most.
TASK_BLOCKS = 64


def write_flat(
    docs: DataFrame,
    *,
    tokenizer: str | None = None,
    end_id: int = 50_256,
    vocabulary: int = 50_257,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One flat file a task; returns ``file, ordinal, doc_id`` in file order, and each file's ``path`` once."""
    out = fresh_path(docs.sparkSession, "flat")
    tokenizer = tokenizer or default_tokenizer()
    kind = "<u4" if vocabulary > 1 << 16 else "<u2"
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        path = f"{out}/part-{task.partitionId():06d}-{task.taskAttemptId()}.{kind[1:]}"
        enc, sink, ordinal = encoder(tokenizer, True), None, 0
        for batch in text_slices(batches):
            first = sink is None
            if first:
                fs, place = open_store(path)
                fs.create_dir(place.rpartition("/")[0], recursive=True)
                sink = fs.open_output_stream(place)
            ids = end.join([*enc.encode(batch["text"].to_pylist()), b""])
            sink.write(np.frombuffer(ids, "<u4").astype(kind).tobytes())
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([task.partitionId()] * n, pa.int32()),
                    pa.array(np.arange(ordinal, ordinal + n)),
                    batch["doc_id"],
                    pa.array([path if first else None] + [None] * (n - 1), pa.string()),
                ],
                names=["file", "ordinal", "doc_id", "path"],
            )
            ordinal += n
        if sink is not None:
            sink.close()

    rows = identified(docs, id_col, text_col).select("doc_id", "text")
    return cut(rows.mapInArrow(write, "file int, ordinal long, doc_id long, path string"), "flat-order")


_SCANNED = "file int, block long, j long, begin long, stop long"


def scan_flat(files: DataFrame, *, end_id: int = 50_256, block_ids: int = BLOCK_IDS) -> DataFrame:
    """``file, ordinal, start, n_tokens`` of each document in flat files (``file, path``)."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, path in zip(batch["file"].to_pylist(), batch["path"].to_pylist(), strict=True):
                fs, place = open_store(path)
                ids = fs.get_file_info(place).size // int(path[-1])
                n = -(-ids // block_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * n, pa.int32()), pa.array([path] * n, pa.string()), pa.array(np.arange(n))], names=["file", "path", "block"]
                )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, path, block in zip(*(batch[c].to_pylist() for c in ("file", "path", "block")), strict=True):
                fs, place = open_store(path)
                width = int(path[-1])
                with fs.open_input_file(place) as f:
                    data = f.read_at(block_ids * width, block * block_ids * width)
                ids = np.frombuffer(data, f"<u{width}")
                stop = np.flatnonzero(ids == end_id)
                begin = np.concatenate(([0], stop[:-1] + 1)) if len(stop) else stop
                # last comes the block's summary: how many ends, and the ids after the last
                tail = len(ids) - (int(stop[-1]) + 1 if len(stop) else 0)
                n = len(stop)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([file] * (n + 1), pa.int32()),
                        pa.array([block] * (n + 1), pa.int64()),
                        pa.array(np.append(np.arange(n), -1)),
                        pa.array(np.append(begin, tail).astype(np.int64)),
                        pa.array(np.append(stop, n).astype(np.int64)),
                    ],
                    names=["file", "block", "j", "begin", "stop"],
                )

    blocks = cut(files.select("file", "path").mapInArrow(sizes, "file int, path string, block long"), "blocks")
    total = blocks.count()
    # a number of its own, or adaptive execution would deal these tiny rows to one task
    tasks = max(1, min(total, files.sparkSession.sparkContext.defaultParallelism), -(-total // TASK_BLOCKS))
    found = cut(blocks.repartitionByRange(tasks, "file", "block").mapInArrow(scan, _SCANNED), "ends")
    # prefix scan over block summaries, a row a block: documents before, and ids since the last end
    summary = found.filter("j < 0").select("file", "block", F.col("stop").alias("ends"), F.col("begin").alias("tail"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block")
    # blocks from one with an end up to the next share a run: their tails are what stays open
    summary = summary.withColumn("first", F.coalesce(F.sum("ends").over(earlier), F.lit(0)))
    summary = summary.withColumn("run", F.sum(F.when(F.col("ends") > 0, 1).otherwise(0)).over(upto))
    in_run = Window.partitionBy("file", "run").orderBy("block")
    summary = summary.withColumn("open", F.sum("tail").over(in_run))
    carried = summary.withColumn("carry", F.coalesce(F.lag("open").over(upto), F.lit(0)))
    carried = bounded(carried.select("file", "block", "first", "carry"), total, 40)
    each = found.filter("j >= 0").join(carried, ["file", "block"])
    begin = F.col("begin") - F.when(F.col("j") == 0, F.col("carry")).otherwise(0)
    return each.select(
        "file",
        (F.col("first") + F.col("j")).alias("ordinal"),
        (F.col("block") * block_ids + begin).alias("start"),
        (F.col("stop") + 1 - begin).alias("n_tokens"),
    )


def op4(docs: DataFrame) -> DataFrame:
    """``doc_id, n_tokens`` (with the end id) of every document, from the files alone."""
    order = write_flat(docs)
    counts = scan_flat(order.filter("path is not null"))
    return order.select("file", "ordinal", "doc_id").join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
