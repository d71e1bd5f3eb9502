"""Timed scans that tell how fast this machine is, and the record they leave."""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import estimator
from . import extract, files

VERSION = "1"


@dataclass
class Calibration:
    calibrated_at: str
    version: str
    cores: int
    speed_factor: float
    corpus: str
    files: int
    bytes: int
    seconds: float
    overhead: float
    parallel_fraction: float
    observed: list[tuple[int, float]] = field(default_factory=list)
    bps: dict[str, int] = field(default_factory=dict)
    languages: list[str] = field(default_factory=list)

    def text(self) -> str:
        return json.dumps(asdict(self), indent=2, sort_keys=True)

    @classmethod
    def parse(cls, text: str | None) -> Calibration | None:
        """The record, or None if there is none that can be read."""
        try:
            raw = json.loads(text or "")
            raw["observed"] = [(int(n), float(s)) for n, s in raw["observed"]]
            return cls(**raw)
        except (ValueError, TypeError, KeyError):
            return None


def _timed(found: DataFrame, registry: extract.Registry, jobs: int) -> float:
    began = time.perf_counter()
    registry.extract(found.repartition(jobs)).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def calibrate(spark: SparkSession, root: str | None = None, cores: int | None = None) -> Calibration:
    """Extract a corpus at a few degrees of parallelism and fit the model to the times.

    Without a corpus generated sources take its place.  What a run over no files takes
    is overhead and counts for no language.
    """
    registry = extract.Registry.discover()
    cores = cores or spark.sparkContext.defaultParallelism
    if root is None:
        sources = estimator.synthetic_files(spark).withColumn("length", F.length("content").cast("long"))
    else:
        sources = files.source_files(spark, root)
    found = registry.with_language(sources).cache()
    shape = {r.language: (r.files, r.bytes) for r in files.corpus_shape(found).collect()}
    _timed(found, registry, 1)  # starts the workers
    overhead = _timed(found.filter(F.lit(False)), registry, 1)
    observed = [(n, _timed(found, registry, n)) for n in estimator.measurement_points(cores)]
    bps = {}
    for language, (count, size) in shape.items():
        if count >= 4 and len(shape) > 1:
            took = _timed(found.filter(F.col("language") == language), registry, 1) - overhead
            bps[language] = max(1, int(size / max(0.01, took)))
    found.unpersist()
    sizes = spark.createDataFrame([(k, v[1]) for k, v in shape.items()], "language string, bytes long")
    expected = estimator.serial_seconds(sizes, estimator.bps_table(spark))
    factor = expected.select(estimator.speed_factor(F.col("serial_s"), F.lit(observed[0][1]), F.lit(overhead)).alias("f")).head().f
    p = estimator.fit_amdahl(spark.createDataFrame(observed, "jobs int, seconds double")).head().p
    return Calibration(
        datetime.now(UTC).isoformat(), VERSION, cores, factor, root or "synthetic", sum(v[0] for v in shape.values()),
        sum(v[1] for v in shape.values()), observed[0][1], overhead, p, observed, bps, sorted(shape),
    )
