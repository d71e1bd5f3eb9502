"""Token-ID output: length-delimited binary records with an offset index.

A data file is a run of frames: length (u64), masked CRC-32 of those eight
bytes (u32), payload, masked CRC-32 of the payload (u32), all little-endian.
A payload is: flags (u8; bit 0: the id is null, bit 1: ids are 32 bits wide),
doc_id (i64), then the ids, 16 bits wide where the vocabulary allows it.
Beside each data file lies an index: the u64 offset of every frame, so that a
shuffled read seeks straight to any record.

Null texts are empty and yield the end id alone; equal and null ids are all
kept (order: nulls first, then doc_id, then the text's checksum); an empty
table yields no files.  Columns besides the two named are not read.  Files are
named by partition and attempt and listed by a written manifest, so a retried
task leaves an orphan that nothing reads.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh_path, identified, text_slices
from .encoding import default_tokenizer, encoder

_FRAME = struct.Struct("<QI")
_BODY = struct.Struct("<Bq")
_CRC = struct.Struct("<I")
#: Bytes held before a write, and read at once.
BUFFER = 4 << 20

MANIFEST = "part int, path string, docs long, tokens long"
RECORDS = "doc_id long, start long, n_tokens long, ids_crc32 long, path string, offset long"


def masked(data: bytes) -> int:
    """CRC-32 turned by 15 bits plus a constant, as a checksum of checksums is weak."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def frame(doc_id: int | None, ids: bytes, wide: bool) -> bytes:
    body = _BODY.pack((doc_id is None) | wide << 1, doc_id or 0)
    body += ids if wide else np.frombuffer(ids, "<u4").astype("<u2").tobytes()
    head = struct.pack("<Q", len(body))
    return head + _CRC.pack(masked(head)) + body + _CRC.pack(masked(body))


def unframe(data: bytes, at: int) -> tuple[int | None, bytes, int]:
    """doc_id, ids as little-endian u32 bytes, and the next frame's offset; checks both checksums."""
    size, crc = _FRAME.unpack_from(data, at)
    if masked(data[at : at + 8]) != crc:
        raise ValueError(f"bad length checksum at {at}")
    begin = at + _FRAME.size
    body = data[begin : begin + size]
    if len(body) != size or masked(body) != _CRC.unpack_from(data, begin + size)[0]:
        raise ValueError(f"bad payload checksum at {at}")
    flags, doc_id = _BODY.unpack_from(body)
    ids = body[_BODY.size :]
    if not flags & 2:
        ids = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
    return (None if flags & 1 else doc_id), ids, begin + size + 4


def read_record(path: str, number: int) -> tuple[int | None, np.ndarray]:
    """One record by its number, through the index."""
    fs, at = open_store(path)
    with fs.open_input_file(at + ".idx") as f:
        size = f.size() // 8
        begin = struct.unpack("<Q", f.read_at(8, 8 * number))[0]
        end = struct.unpack("<Q", f.read_at(8, 8 * number + 8))[0] if number + 1 < size else None
    with fs.open_input_file(at) as f:
        data = f.read_at((end or f.size()) - begin, begin)
    doc_id, ids, _ = unframe(data, 0)
    return doc_id, np.frombuffer(ids, "<u4")


def write_records(
    docs: DataFrame,
    *,
    tokenizer: str | None = None,
    end_id: int = 2,
    vocabulary: int = 50_257,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
) -> DataFrame:
    """Write every text's ids and ``end_id`` in ascending id order; returns the manifest."""
    spark = docs.sparkSession
    out = path or fresh_path(spark, "records")
    tokenizer, wide = tokenizer or default_tokenizer(), vocabulary > 1 << 16
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        target = f"{out}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
        enc, fs, sink, docs_n, tokens, at = encoder(tokenizer), None, None, 0, 0, 0
        offsets: list[int] = []
        for batch in text_slices(batches):
            if fs is None:
                fs, place = open_store(target)
                fs.create_dir(place.rpartition("/")[0], recursive=True)
                sink, index = fs.open_output_stream(place), fs.open_output_stream(place + ".idx")
            held = []
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), enc.encode(batch["text"].to_pylist()), strict=True):
                held.append(frame(doc_id, ids + end, wide))
                offsets.append(at)
                at += len(held[-1])
                tokens += len(ids) // 4 + 1
                docs_n += 1
            sink.write(b"".join(held))
            index.write(np.array(offsets, "<u8").tobytes())
            offsets = []
        if sink is not None:
            sink.close()
            index.close()
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([task.partitionId()], pa.int32()), "path": [target], "docs": [docs_n], "tokens": [tokens]}
            )

    rows = identified(docs, id_col, text_col)
    ordered = rows.repartitionByRange("doc_id", "tag").sortWithinPartitions("doc_id", "tag").select("doc_id", "text")
    return cut(ordered.mapInArrow(write, MANIFEST), "manifest")


def read_records(manifest: DataFrame) -> DataFrame:
    """Every record of the files, verified, with the count of ids before it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch["path"].to_pylist(), batch["base"].to_pylist(), strict=True):
                fs, place = open_store(path)
                with fs.open_input_file(place + ".idx") as f:
                    offsets = np.frombuffer(f.read(), "<u8").astype(np.int64)
                with fs.open_input_file(place) as f:
                    bounds = np.append(offsets, f.size())
                    i = 0
                    while i < len(offsets):
                        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + BUFFER, "right")) - 1)
                        data, rows = f.read_at(int(bounds[j] - bounds[i]), int(bounds[i])), []
                        for k in range(i, j):
                            doc_id, ids, _ = unframe(data, int(bounds[k] - bounds[i]))
                            rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), path, int(bounds[k])))
                            start += len(ids) // 4
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.string(), pa.int64()], strict=True)],
                            names=["doc_id", "start", "n_tokens", "ids_crc32", "path", "offset"],
                        )
                        i = j

    # one row a file: the running sum over them is small whatever the corpus holds
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("part", "path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    # a number of its own, or adaptive execution would deal these tiny rows to one task
    return files.repartitionByRange(max(1, manifest.count()), "part").mapInArrow(read, RECORDS)


def op8(docs: DataFrame) -> DataFrame:
    """Digest of every document as read back from its files."""
    return read_records(write_records(docs)).select("doc_id", "start", "n_tokens", "ids_crc32")
