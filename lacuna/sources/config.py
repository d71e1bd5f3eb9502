"""Settings: TOML configuration, reviewed suppressions, entry points, run logs."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import selectors

CONFIG_NAME = "lacuna.toml"


@dataclass(frozen=True)
class Selector:
    enabled: bool = True
    min_members: int = 3
    exclude: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()


@dataclass(frozen=True)
class Config:
    exclude: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    min_confidence: float = 0.8
    #: Read and echoed; only the selectors' own ``min_members`` filter.
    min_group_size: int = 3
    directory: Selector = field(default_factory=lambda: Selector(kinds=selectors.DIRECTORY_KINDS))
    decorator: Selector = field(default_factory=lambda: Selector(exclude=selectors.DECORATOR_EXCLUDES))
    parent_class: Selector = field(default_factory=lambda: Selector(exclude=selectors.PARENT_EXCLUDES, kinds=selectors.PARENT_KINDS))

    def overridden(self, languages: str | None = None, exclude: list[str] | None = None) -> Config:
        """Command-line overrides: languages replace, excludes append."""
        wanted = tuple(x.strip() for x in languages.split(",") if x.strip()) if languages else self.languages
        return replace(self, languages=wanted, exclude=(*self.exclude, *(exclude or ())))


def from_dict(raw: dict[str, Any]) -> Config:
    base, scan, mining, chosen = Config(), raw.get("scan", {}), raw.get("mining", {}), raw.get("selectors", {})

    def selector(name: str) -> Selector:
        default, own = getattr(base, name), chosen.get(name, {})
        return Selector(
            own.get("enabled", default.enabled),
            own.get("min_members", default.min_members),
            tuple(own.get("exclude", default.exclude)),
            tuple(own.get("kind_filter", default.kinds)),
        )

    return Config(
        tuple(scan.get("exclude", base.exclude)),
        tuple(scan.get("languages", base.languages)),
        mining.get("min_confidence", base.min_confidence),
        mining.get("min_group_size", base.min_group_size),
        *(selector(n) for n in ("directory", "decorator", "parent_class")),
    )


def from_file(path: Path) -> Config:
    with path.open("rb") as f:
        return from_dict(tomllib.load(f))


def find_config(start: Path) -> Path | None:
    """The nearest configuration file, upwards."""
    for folder in [start, *start.parents]:
        if (folder / CONFIG_NAME).is_file():
            return folder / CONFIG_NAME
    return None


ENTRY = "entity string, rule string, scope string, reason string, created string"


def _toml(path: Path) -> str:
    try:
        return path.read_text()
    except OSError:
        return ""


def _parsed(text: str) -> dict[str, Any]:
    try:
        return tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return {}


def suppressions(spark: SparkSession, text: str) -> DataFrame:
    """``[[suppress]]`` blocks of TOML; none if it can't be read."""
    keys = [c.split()[0] for c in ENTRY.split(", ")]
    blocks = _parsed(text).get("suppress", [])
    rows = [tuple(None if b.get(k) is None else str(b[k]) for k in keys) for b in blocks if isinstance(b, dict)]
    return spark.createDataFrame(rows, ENTRY)


def project_suppressions(spark: SparkSession, root: Path) -> DataFrame:
    """The reviewed suppressions of the project's own file."""
    return suppressions(spark, _toml(root / CONFIG_NAME))


def entry_points(spark: SparkSession, text: str) -> DataFrame:
    """``suffix, class`` of ``[project.entry-points]`` declarations such as ``pkg.mod:Class``."""
    rows = []
    groups = _parsed(text).get("project", {}).get("entry-points", {})
    for group in groups.values():
        for target in group.values() if isinstance(group, dict) else ():
            module, _, name = str(target).partition(":")
            if name:
                rows.append((module.strip().replace(".", "/") + ".py", name.split("[")[0].strip()))
    return spark.createDataFrame(rows, "suffix string, class string")


def registered_entry_points(spark: SparkSession, root: Path) -> DataFrame:
    return entry_points(spark, _toml(root / "pyproject.toml"))


RUN = (
    "run_id string, ts string, version string, cores int, jobs int, root string, files long, entities long, "
    "by_language_bytes map<string,long>, stage_ms map<string,double>, duration_ms double, files_unchanged long, gaps long"
)


def no_runs(spark: SparkSession) -> DataFrame:
    return runs(spark.createDataFrame([], RUN))


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """Run records from JSON lines, in one file or a folder; malformed lines are dropped, times without a zone are UTC."""
    return runs(spark.read.schema(RUN).option("mode", "DROPMALFORMED").json(path))


def runs(raw: DataFrame) -> DataFrame:
    size = F.aggregate(F.map_values("by_language_bytes"), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return raw.select(
        "run_id",
        F.try_to_timestamp("ts").alias("ts"),
        "cores",
        "version",
        "root",
        F.coalesce(size, F.lit(0)).alias("bytes"),
        F.col("stage_ms")["mine"].alias("mine_ms"),
        F.col("stage_ms")["finalize"].alias("finalize_ms"),
    )


def json_settings(path: Path, defaults: dict[str, Any]) -> dict[str, Any]:
    """Settings over defaults; an unreadable file or a job count below one counts as unset."""
    try:
        raw = json.loads(path.read_text())
    except (OSError, ValueError):
        raw = {}
    found = defaults | ({k: v for k, v in raw.items() if k in defaults} if isinstance(raw, dict) else {})
    jobs = found.get("jobs_default")
    if jobs is not None and (not isinstance(jobs, int) or jobs < 1):
        found["jobs_default"] = None
    return found
