"""Incremental state as Parquet tables: what changed, what to replace, what is gone."""

from __future__ import annotations

import json
import os
import time
import uuid
from contextlib import contextmanager
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
#: Where a project's state lies in it, the lock and the run records in the state.
STATE, LOCK, RUNS = ".lacuna", "lockfile", "runs"


class StateVersionError(RuntimeError):
    """The state on disk is newer than this program."""


class StateLockedError(RuntimeError):
    """Another scan holds the state."""


def content_hash(content: str, fingerprint: str):
    """SHA-256 of content and extractor fingerprint, so a new extractor re-reads every file."""
    return F.sha2(F.concat(F.col(content), F.lit(fingerprint).cast("binary")), 256)


def changed_files(current: DataFrame, stored: DataFrame, cold: list[str] | None = None) -> DataFrame:
    """Files (``path, hash``) to read again: new, different, or under a ``cold`` path."""
    old = stored.select("path", F.col("hash").alias("old_hash"))
    forced = F.lit(False)
    for p in cold or []:
        clean = p.strip("/")
        forced = forced | (F.lit(clean in ("", "."))) | (F.col("path") == clean) | F.col("path").startswith(clean + "/")
    found = current.join(old, "path", "left")
    return found.filter(~F.col("hash").eqNullSafe(F.col("old_hash")) | forced).drop("old_hash")


def tombstones(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Stored paths that are no longer there."""
    return stored.select("path").join(current.select("path"), "path", "left_anti")


def replaced(old: DataFrame, new: DataFrame, changed: DataFrame, gone: DataFrame, path_col: str = "file_path") -> DataFrame:
    """Rows of unchanged files from ``old``, all others from ``new``."""
    stale = changed.select(F.col("path").alias(path_col)).unionByName(gone.select(F.col("path").alias(path_col)))
    return old.join(stale.distinct(), path_col, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def upserted(stored: DataFrame, rows: DataFrame, key: str = "path") -> DataFrame:
    """``stored`` with ``rows`` put over it."""
    return stored.join(rows.select(key), key, "left_anti").select(*stored.columns).unionByName(rows.select(*stored.columns))


def last_definitions(extracted: DataFrame) -> DataFrame:
    """One row an entity id: the last definition's values at the first one's place."""
    rest = [c for c in extracted.columns if c not in ("entity_id", "ordinal")]
    last = F.max_by(F.struct(*rest), F.struct("file_path", "ordinal"))
    merged = extracted.groupBy("entity_id").agg(last.alias("r"), F.min("ordinal").alias("ordinal"))
    return merged.select("entity_id", "ordinal", "r.*").select(*extracted.columns)


def bytes_by_language(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def set_to_json(values: str):
    return F.to_json(F.array_sort(F.col(values)))


def set_from_json(text: str):
    return F.array_sort(F.array_distinct(F.from_json(F.col(text), "array<string>")))


class Folder:
    """Small files in a folder of any file system that Spark reaches, as executors must see it too."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        at = self._at(root)
        self.fs = at.getFileSystem(self.conf)
        self.root = self.fs.makeQualified(at).toString()

    def _at(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join(parts))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._at(self.root, name) if name else self._at(self.root))

    def read(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        size = self.fs.getFileStatus(self._at(self.root, name)).getLen()
        stream = self.fs.open(self._at(self.root, name))
        try:
            return bytes(stream.readNBytes(size)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str, *, fresh: bool = False) -> None:
        """Put a whole file in place at once; with ``fresh`` fail if it is there."""
        if fresh:
            stream = self.fs.create(self._at(self.root, name), False)
        else:
            stream = self.fs.create(self._at(self.root, f".{name.replace('/', '-')}.next"), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not fresh:
            over = self.jvm.org.apache.hadoop.fs.Options.Rename
            modes = self.jvm.java.lang.reflect.Array.newInstance(over.OVERWRITE.getClass(), 1)
            modes[0] = over.OVERWRITE
            target = self._at(self.root, name)
            self.fs.mkdirs(target.getParent())
            context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.conf)
            context.rename(self._at(self.root, f".{name.replace('/', '-')}.next"), target, modes)

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._at(self.root))] if self.exists() else []

    def delete(self, name: str = "") -> None:
        self.fs.delete(self._at(self.root, name) if name else self._at(self.root), True)

    def local(self) -> Path | None:
        """The folder as a path of this machine, if it is one."""
        return Path(self.root.removeprefix("file:").replace("//", "/")) if self.root.startswith("file:") else None


class StateStore:
    """Parquet tables of one project; every write makes a new version, then moves the pointer."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, Folder(spark, root)
        mark = self.folder.read("version")
        if mark is not None and int(mark) > VERSION:
            raise StateVersionError(f"state version {mark} is newer than {VERSION}")
        if mark is None:
            self.folder.write("version", str(VERSION))

    @property
    def root(self) -> str:
        return self.folder.root

    def read(self, table: str, schema: str) -> DataFrame:
        name = self.folder.read(f"{table}.current")
        if name is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.folder.path(name))

    def write(self, table: str, rows: DataFrame) -> None:
        """Replace a table; readers of the old version keep their files until the next write but one."""
        name = f"{table}-{uuid.uuid4().hex}"
        rows.write.parquet(self.folder.path(name))
        before = self.folder.read(f"{table}.current")
        self.folder.write(f"{table}.current", name)
        for old in self.folder.names():
            if old.startswith(f"{table}-") and old not in (name, before):
                self.folder.delete(old)

    def begin_run(self, run_id: str, **known) -> None:
        """Leave a record of a run that has begun; it has no time yet, so no estimate counts it."""
        self.folder.write(f"{RUNS}/{run_id}.json", json.dumps({"run_id": run_id, "started_at": run_id} | known) + "\n")

    def end_run(self, run_id: str, record: dict) -> None:
        """Replace the record of the run's beginning; each run is a line in a file of its own."""
        self.folder.write(f"{RUNS}/{run_id}.json", json.dumps({"run_id": run_id, "started_at": run_id} | record, sort_keys=True) + "\n")

    def suppress(self, rows: DataFrame) -> None:
        schema = "short_id string, full_id string, reason string, created_at timestamp"
        self.write("suppressions", upserted(self.read("suppressions", schema), rows, "short_id"))

    def unsuppress(self, short_id: str) -> None:
        schema = "short_id string, full_id string, reason string, created_at timestamp"
        kept = self.read("suppressions", schema).filter(F.col("short_id") != short_id)
        self.write("suppressions", kept)

    def purge(self) -> None:
        """Delete the state, if it is one."""
        if not self.folder.exists("version"):
            raise ValueError(f"{self.root} holds no state")
        self.folder.delete()

    @contextmanager
    def lock(self):
        """Non-blocking: a second scan fails at once.

        A local folder is locked by the system, which lets go when the process ends;
        elsewhere the lock is a file that only one process can create.
        """
        note, local = f"{os.getpid()} {time.time()}", self.folder.local()
        if local is not None:
            import fcntl

            with (local / LOCK).open("w") as f:
                try:
                    fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                except OSError as e:
                    raise StateLockedError(str(self.root)) from e
                f.write(note)
                yield self
            return
        try:
            self.folder.write(LOCK, note, fresh=True)
        except Py4JJavaError as e:
            raise StateLockedError(f"{self.root}/{LOCK} is there: {self.folder.read(LOCK)}") from e
        try:
            yield self
        finally:
            self.folder.delete(LOCK)


def state_folders(top: Path, noise: list[str]) -> list[Path]:
    """Folders below ``top`` that hold a project's state; noise directories are not entered."""
    found = []
    for at, inner, _ in os.walk(top):
        if STATE in inner and (Path(at) / STATE / "version").is_file():
            found.append(Path(at) / STATE)
        inner[:] = [d for d in inner if d != STATE and d not in noise]
    return sorted(found)


def latest_runs(runs: DataFrame, n: int = 30) -> DataFrame:
    return runs.orderBy(F.desc("ts"), F.desc("run_id")).limit(n)

