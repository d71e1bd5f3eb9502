"""Line dedup by overlapping three-line windows.

Lines are what newlines part.  Every three consecutive lines of a document are
hashed (128 bits); a window that occurs again anywhere, in this document or a
later one, is a later occurrence.  Windows are ordered by (doc_id, checksum of
the text, line number), nulls first.  The lines that later occurrences cover are
merged and removed; the first occurrence stays.

Null text is empty, also in what is returned.  Texts under three lines have no windows and stay as they
are.  Rows equal in id and text count as one document and share its result; null
ids are kept.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, identified, same_doc, text_slices

#: Lines in a window.
WINDOW = 3


def later_windows(rows: DataFrame) -> DataFrame:
    """``doc_id, tag, at``: the first line of every later occurrence of a window."""
    lines = rows.select("doc_id", "tag", F.split("text", "\n", -1).alias("lines")).filter(F.size("lines") >= WINDOW)

    def pair(_, i):
        parts = [F.get("lines", i + k) for k in range(WINDOW)]
        return F.struct(F.xxhash64(*parts).alias("h"), F.xxhash64(F.lit(1), *parts).alias("g"))

    pairs = F.slice(F.transform("lines", pair), F.lit(1), F.size("lines") - (WINDOW - 1))
    windows = lines.select("doc_id", "tag", F.posexplode(pairs).alias("at", "w"))
    windows = cut(windows.select("doc_id", "tag", "at", "w.h", "w.g"), "windows")
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tag", "at")
    # equal rows have equal places, so they alone make no window a repeated one
    often = windows.groupBy("h", "g").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    often = cut(often.filter("first != last").select("h", "g", "first"), "repeated")
    later = windows.join(often, ["h", "g"])
    first = (
        F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
        & (F.col("tag") == F.col("first.tag"))
        & (F.col("at") == F.col("first.at"))
    )
    return later.filter(~first).select("doc_id", "tag", "at")


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rest: bool = False) -> DataFrame:
    """``doc_id, n_lines, n_removed, text`` of every row; ``text`` is what is left.

    With ``rest`` a struct of the row's own columns comes along.
    """
    rows = identified(docs, id_col, text_col, rest)
    later = later_windows(rows).groupBy("doc_id", "tag").agg(F.collect_set("at").alias("starts"))
    names = ["doc_id", "n_lines", "n_removed", "text"] + ["rest"] * rest

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            sizes, gone, left = [], [], []
            for text, starts in zip(batch["text"].to_pylist(), batch["starts"].to_pylist(), strict=True):
                if not starts:
                    sizes.append(text.count("\n") + 1)
                    gone.append(0)
                    left.append(text)
                    continue
                lines = text.split("\n")
                covered = {at + k for at in starts for k in range(WINDOW)}
                sizes.append(len(lines))
                gone.append(len(covered))
                left.append("\n".join(x for i, x in enumerate(lines) if i not in covered))
            made = [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(left, pa.string())]
            yield pa.RecordBatch.from_arrays(made + ([batch["rest"]] if rest else []), names=names)

    joined = rows.join(later, same_doc(rows, later), "left").select(rows["doc_id"], "text", "starts", *["rest"] * rest)
    schema = rows.select("doc_id", F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"), "text", *["rest"] * rest)
    return joined.mapInArrow(remove, schema.schema)


ORACLE = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
p AS (SELECT doc_id, lines, unnest(generate_series(1, len(lines) - 2)) AS pos FROM d),
w AS (SELECT doc_id, pos, row_number() OVER (
        PARTITION BY lines[pos] || chr(10) || lines[pos + 1] || chr(10) || lines[pos + 2]
        ORDER BY doc_id, pos) AS nth FROM p),
covered AS (SELECT DISTINCT doc_id, pos + k AS line FROM w, (VALUES (0), (1), (2)) AS o(k) WHERE nth > 1),
l AS (SELECT doc_id, unnest(lines) AS line_text, generate_subscripts(lines, 1) AS line FROM d)
SELECT l.doc_id, count(*) AS n_lines, count(c.line) AS n_removed,
       coalesce(string_agg(CASE WHEN c.line IS NULL THEN line_text END, chr(10) ORDER BY l.line), '') AS text
FROM l LEFT JOIN covered c ON c.doc_id = l.doc_id AND c.line = l.line
GROUP BY l.doc_id
"""
