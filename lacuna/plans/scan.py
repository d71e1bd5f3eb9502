"""The whole scan: from sources or a corpus to deduplicated, unsuppressed gaps."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property
from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ..operators import closure, enrichment, finalize, frequency, selectors, series, symmetry
from ..operators.joins import bounded
from ..schema import Corpus, Findings
from ..sources import config as settings
from ..sources import extract, files, state


@dataclass
class ScanResult:
    """Lazy frames; nothing runs until one is read."""

    corpus: Corpus
    members: DataFrame
    found: Findings
    #: One gap for each entity and value, suppressed ones included.
    every: DataFrame
    gaps: DataFrame
    held: list[DataFrame] = field(default_factory=list)

    @property
    def rules(self) -> DataFrame:
        return self.found.rules

    @cached_property
    def groups(self) -> DataFrame:
        return selectors.groups(self.members)

    def statistics(self) -> DataFrame:
        return finalize.scan_statistics(self.corpus.entities, self.groups, self.rules, self.gaps)

    def register(self, spark: SparkSession, prefix: str = "") -> None:
        """Temporary views for SQL users."""
        frames = {
            "entities": self.corpus.entities,
            "features": self.corpus.features,
            "feature_values": self.corpus.values,
            "group_members": self.members,
            "rules": self.rules,
            "gaps": self.gaps,
        }
        for name, df in frames.items():
            df.createOrReplaceTempView(prefix + name)

    def release(self) -> None:
        for df in self.held:
            df.unpersist()


def select_groups(corpus: Corpus, config: settings.Config) -> DataFrame:
    d, t, p = config.directory, config.decorator, config.parent_class
    chosen = [
        selectors.directory_groups(corpus.entities, d.min_members, d.kinds) if d.enabled else None,
        selectors.decorator_groups(corpus.values, t.min_members, t.exclude) if t.enabled else None,
        selectors.parent_class_groups(corpus.entities, corpus.values, p.min_members, p.exclude, p.kinds) if p.enabled else None,
    ]
    if not any(c is not None for c in chosen):
        return selectors.directory_groups(corpus.entities.limit(0), d.min_members)
    return selectors.union_groups(*chosen)


def strategies(corpus: Corpus, members: DataFrame, config: settings.Config, texts: DataFrame | None = None) -> list[Findings]:
    """All strategies in their order."""
    e = corpus.entities
    return [
        frequency.mine(members, corpus.features, corpus.values, min_confidence=config.min_confidence),
        symmetry.symmetry_gaps(e),
        symmetry.call_pair_gaps(e, corpus.values),
        series.series_gaps(e),
        series.letter_series_gaps(e),
        series.version_directory_gaps(e),
        series.ordinal_series_gaps(e),
        closure.unused_class_gaps(e, corpus.features, corpus.values, texts),
    ]


def scan_corpus(
    corpus: Corpus,
    config: settings.Config | None = None,
    *,
    registered: DataFrame | None = None,
    texts: DataFrame | None = None,
    local: DataFrame | None = None,
    project: DataFrame | None = None,
) -> ScanResult:
    """Enrich, group, mine, dedup, suppress.

    The canonical frames are read by every strategy, and rules and gaps by every report,
    so they are kept on the executors' disks and memory until ``release``.
    """
    config = config or settings.Config()
    corpus = enrichment.enrich(corpus, registered)
    kept = [df.persist(StorageLevel.MEMORY_AND_DISK) for df in (corpus.entities, corpus.features, corpus.values)]
    corpus = Corpus(*kept)
    members = select_groups(corpus, config)
    found = finalize.union_findings(strategies(corpus, members, config, texts))
    found = Findings(found.rules.persist(StorageLevel.MEMORY_AND_DISK), found.gaps)
    every = finalize.dedup_gaps(found.gaps).persist(StorageLevel.MEMORY_AND_DISK)
    gaps = every
    if local is not None:
        gaps = finalize.suppress_local(gaps, local)
    if project is not None:
        gaps = finalize.suppress_project(gaps, project)
    return ScanResult(corpus, members, found, every, gaps, [*kept, found.rules, every])


def tree_inputs(spark: SparkSession, root: str, config: settings.Config, registry: extract.Registry) -> dict[str, DataFrame]:
    """What a scan takes from a tree besides its corpus: entry points, sources and suppressions."""
    from pathlib import Path

    here = Path(root)
    # the token pass reads every source, excluded ones too
    everything = registry.with_language(files.source_files(spark, root), list(config.languages) or None)
    return {
        "registered": settings.registered_entry_points(spark, here),
        "texts": files.texts(everything),
        "project": settings.project_suppressions(spark, here),
    }


def scan_tree(spark: SparkSession, root: str, config: settings.Config | None = None, *, local: DataFrame | None = None) -> ScanResult:
    """Scan a directory of source files."""
    config = config or settings.Config()
    registry = extract.Registry.discover()
    found = files.source_files(spark, root, excludes=list(config.exclude))
    found = registry.with_language(found, list(config.languages) or None)
    corpus = extract.corpus(state.last_definitions(registry.extract(found)))
    return scan_corpus(corpus, config, local=local, **tree_inputs(spark, root, config, registry))


_EXTRACTED = "entity_id string, kind string, qualified_name string, file_path string, line int, ordinal long, features map<string,array<string>>"
_FILES = "path string, hash string"
#: What a path may take in a broadcast.
PATH_BYTES = 256
SUPPRESSION = "short_id string, full_id string, reason string, created_at timestamp"


class Refreshed(NamedTuple):
    """All extracted rows of the state, and how many files there are and were read again."""

    rows: DataFrame
    files: int
    changed: int


def refresh(spark: SparkSession, files_now: DataFrame, store: state.StateStore, registry: extract.Registry, cold: list[str] | None = None) -> Refreshed:
    """Bring the state up to date with ``path, language, content``.

    Only changed files are read again; rows of files that are gone leave the state.
    Contents are hashed where they are read: paths alone are joined, and contents then
    meet the smaller of the changed and the unchanged paths.
    """
    stored, old = store.read("files", _FILES), store.read("extracted", _EXTRACTED)
    current = files_now.select("path", state.content_hash("content", extract.FINGERPRINT).alias("hash")).persist(StorageLevel.MEMORY_AND_DISK)
    changed = state.changed_files(current, stored, cold).persist(StorageLevel.MEMORY_AND_DISK)
    n_files, n_changed = current.count(), changed.count()
    if n_changed == n_files:
        again = files_now
    elif 2 * n_changed <= n_files:
        again = files_now.join(bounded(changed.select("path"), n_changed, PATH_BYTES), "path", "left_semi")
    else:
        same = current.select("path").join(changed.select("path"), "path", "left_anti")
        again = files_now.join(bounded(same, n_files - n_changed, PATH_BYTES), "path", "left_anti")
    gone = state.tombstones(stored, current)
    store.write("extracted", state.replaced(old, registry.extract(again), changed, gone))
    store.write("files", current)
    current.unpersist()
    changed.unpersist()
    return Refreshed(store.read("extracted", _EXTRACTED), n_files, n_changed)


def rescan(
    spark: SparkSession,
    root: str,
    store: state.StateStore,
    config: settings.Config | None = None,
    registry: extract.Registry | None = None,
    cold: list[str] | None = None,
) -> tuple[ScanResult, Refreshed]:
    """An incremental scan of a directory with its state; the command line and watch mode both run this."""
    config, registry = config or settings.Config(), registry or extract.Registry.discover()
    now = registry.with_language(files.source_files(spark, root, excludes=list(config.exclude)), list(config.languages) or None)
    fresh = refresh(spark, now, store, registry, cold)
    corpus = extract.corpus(state.last_definitions(fresh.rows))
    local = store.read("suppressions", SUPPRESSION)
    return scan_corpus(corpus, config, local=local, **tree_inputs(spark, root, config, registry)), fresh
