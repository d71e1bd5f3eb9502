"""Watch mode: a stream of ticks; each that finds the tree changed scans it anew.

Mining is corpus-wide, so a batch re-reads the state and no state lives in the
stream.  A file stream would see new files only, so a tick lists the tree instead:
names, sizes and times, without contents.  Edits and deletions start a scan like new
files do.  The scan is the one that ``check`` runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import scan
from ..sources import extract, files, state
from ..sources import config as settings

BINARY = "path string, modificationTime timestamp, length long, content binary"


def listing(spark: SparkSession, root: str, config: settings.Config, registry: extract.Registry) -> tuple:
    """A digest of the sources' names, sizes and times."""
    found = registry.with_language(files.listed(spark, root, excludes=list(config.exclude)), list(config.languages) or None)
    mark = F.xxhash64("path", "length", "modified")
    return tuple(found.agg(F.count("*"), F.sum(mark.cast("decimal(38,0)"))).head())


def watch(
    spark: SparkSession,
    root: str,
    store: state.StateStore,
    report: Callable[[scan.ScanResult, int], None],
    *,
    checkpoint: str,
    config: settings.Config | None = None,
    once: bool = False,
    interval: str = "2 seconds",
) -> StreamingQuery:
    """Start watching; ``report`` gets each new result.  ``once`` takes what is there and stops."""
    config = config or settings.Config()
    registry = extract.Registry.discover()
    seen: list[tuple] = []

    def batch(_: DataFrame, number: int) -> None:
        now = listing(spark, root, config, registry)
        if seen == [now]:
            return
        result, _ = scan.rescan(spark, root, store, config, registry)
        report(result, number)
        result.release()
        seen[:] = [now]

    if once:
        stream = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").load(root).select("path")
        writer = stream.writeStream.foreachBatch(batch).trigger(availableNow=True)
    else:
        ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        writer = ticks.writeStream.foreachBatch(batch).trigger(processingTime=interval)
    return writer.option("checkpointLocation", checkpoint).start()
