"""Shared plumbing: the folder every executor sees, lineage cuts and text access."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handed to Python code in slices of about so many bytes.
SLICE_BYTES = 4 << 20
#: Largest relation that is ever broadcast; beyond it a shuffle join runs.
BROADCAST_BYTES = 32 << 20


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where it is unset a temporary one, but only if driver and executors are one process.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="lacuna-")
    return _own[context.applicationId]


_made: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def release(spark: SparkSession) -> int:
    """Delete all that operators wrote to the shared folder, once no result needs it any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        gone += path.getFileSystem(conf).delete(path, True)
    return gone


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later stages start from replicated files instead of the lineage, so a lost
    executor costs the running tasks only.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get by bytes, as texts differ in length."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":  # the default; another value is the user's
        spark.conf.set(key, f"{SLICE_BYTES}b")


def bounded_sample(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The first ``n`` rows by a hash of ``keys``, or nearly so many; few rows leave any task."""
    total = df.count()
    order = F.xxhash64(*keys)
    if total > 2 * n:
        parts = 1 << 20
        df = df.filter(F.pmod(order, F.lit(parts)) < max(1, round(1.5 * n / total * parts)))
    return df.orderBy(order, *keys).limit(n)


def within_bytes(rows: DataFrame, column: str, limit: int, *keys: str) -> DataFrame:
    """Of boundedly many rows those that come first by a hash of ``keys`` and hold ``limit`` bytes in all."""
    rows = cut(rows, "sample")
    sizes = rows.select(*keys, F.octet_length(column).alias("bytes")).orderBy(F.xxhash64(*keys), *keys).toArrow()
    fits = np.cumsum(sizes["bytes"].to_numpy()) <= limit
    if fits.all():
        return rows
    few = rows.sparkSession.createDataFrame(sizes.filter(pa.array(fits)).select(list(keys)))
    on = F.lit(True)
    for k in keys:
        on = on & rows[k].eqNullSafe(few[k])
    return rows.join(F.broadcast(few), on, "left_semi")


def bounded(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint when ``rows`` of ``row_bytes`` fit the bound, else as it is."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of a batch, each holding about ``limit`` bytes of ``column``."""
    at, size = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        size += (n or 0) + 16
        if size >= limit:
            yield batch.slice(at, i + 1 - at)
            at, size = i + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)


def text_slices(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, column)


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rest: bool = False) -> DataFrame:
    """``doc_id``, ``tag``, ``text`` (null text: empty), and with ``rest`` the whole row as a struct.

    ``tag`` is the text's crc32: repeated ids with other texts stay apart, and
    repeated rows share one key and one result.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.crc32(text.cast("binary")) - F.lit(1 << 31)).cast("int").alias("tag"),
        text.alias("text"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rest")] if rest else []),
    )


def same_doc(a: DataFrame, b: DataFrame):
    """Null-safe equality of ``doc_id`` and ``tag``."""
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["tag"] == b["tag"])
