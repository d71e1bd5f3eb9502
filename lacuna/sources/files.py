"""Finding sources: noise directories, exclude globs, extension dispatch, corpus shape."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Directories that hold no sources of a project's own.
NOISE_DIRECTORIES = [
    ".git", "__pycache__", ".venv", "venv", "env",
    "node_modules", ".mypy_cache", ".pytest_cache", ".ruff_cache",
    "build", "dist", ".tox", ".eggs", "site",
    ".lacuna",
    "target",
    ".gradle",
    ".next", ".nuxt", "out",
    ".cargo",
    "vendor",
]


def glob_regex(pattern: str) -> str:
    """A POSIX glob over whole paths as a regular expression; ``**`` spans directories."""
    out = []
    parts = pattern.strip("/").split("/")
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out.append(".*" if last else "(?:[^/]+/)*")
            continue
        at, text = 0, ""
        while at < len(part):
            c = part[at]
            end = part.find("]", at + 2) if c == "[" else -1
            if c == "*":
                text += "[^/]*"
            elif c == "?":
                text += "[^/]"
            elif end > 0:
                inner = part[at + 1 : end]
                text += "[" + ("^" + inner[1:] if inner[0] == "!" else inner).replace("\\", "\\\\") + "]"
                at = end
            else:
                text += re.escape(c)
            at += 1
        out.append(text if last else text + "/")
    return "^" + "".join(out) + "$"


def scan_filter(files: DataFrame, *, excludes: list[str] | None = None, noise: list[str] | None = None) -> DataFrame:
    """Paths (relative, column ``path``) outside noise directories and excluded globs."""
    words = F.array(*[F.lit(x) for x in (noise or NOISE_DIRECTORIES)])
    kept = files.filter(~F.arrays_overlap(F.split("path", "/"), words))
    for pattern in excludes or []:
        kept = kept.filter(~F.col("path").rlike(glob_regex(pattern)))
    return kept


def _under(spark: SparkSession, root: str, excludes: list[str] | None) -> DataFrame:
    base = root.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    full = F.regexp_replace("path", "^[a-z0-9+.-]+:(//[^/]*(?=/))?", "")
    plain = re.sub(r"^[a-z0-9+.-]+:(//[^/]*(?=/))?", "", base)
    rows = found.withColumn("path", F.substring(full, len(plain) + 2, 1 << 20)).withColumnRenamed("modificationTime", "modified")
    return scan_filter(rows, excludes=excludes)


def source_files(spark: SparkSession, root: str, *, excludes: list[str] | None = None) -> DataFrame:
    """``path`` relative to the root, ``length``, ``content``; unread content is never loaded."""
    return _under(spark, root, excludes).select("path", "length", "content")


def listed(spark: SparkSession, root: str, *, excludes: list[str] | None = None) -> DataFrame:
    """``path, length, modified`` of the files, without their contents."""
    return _under(spark, root, excludes).select("path", "length", "modified")


def corpus_shape(files: DataFrame) -> DataFrame:
    """Files and bytes of each language, from metadata alone."""
    return files.groupBy("language").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def texts(files: DataFrame) -> DataFrame:
    """``path, text`` for the closure's token pass; bytes that are no UTF-8 are replaced."""
    return files.select("path", F.decode(F.col("content"), "UTF-8").alias("text"))

