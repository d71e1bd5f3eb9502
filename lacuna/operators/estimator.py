"""How long a scan will take: throughput tables, Amdahl's law and past runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names

PARALLEL_FRACTION, WORKER_STARTUP, DEFAULT_BPS = 0.55, 0.06, 15_000_000
#: Baseline bytes a second of each language.
BASELINE_BPS = {
    "python": 32_000_000,
    "javascript": 18_000_000,
    "typescript": 18_000_000,
    "tsx": 18_000_000,
    "rust": 19_000_000,
    "go": 22_000_000,
    "java": 16_000_000,
    "ruby": 28_000_000,
    "csharp": 13_000_000,
    "swift": 15_000_000,
    "c": 10_000_000,
    "cpp": 9_000_000,
    "php": 25_000_000,
    "kotlin": 12_000_000,
    "scala": 14_000_000,
    "lua": 35_000_000,
    "bash": 40_000_000,
}
RUN_DAYS, RUN_COUNT, LEAST_RUNS = 90, 200, 3


def bps_table(spark: SparkSession, factor: float = 1.0, overrides: dict[str, int] | None = None) -> DataFrame:
    """Bytes a second: an override, else the baseline times the machine's factor; one at least."""
    known = overrides or {}
    rows = [(lang, max(1, int(known[lang] if lang in known else base * factor))) for lang, base in BASELINE_BPS.items()]
    return spark.createDataFrame(rows, "language string, bps long")


def serial_seconds(shape: DataFrame, table: DataFrame) -> DataFrame:
    """One row ``serial_s`` from ``language, bytes``; unknown languages run at the default."""
    rows = shape.join(F.broadcast(table), "language", "left").withColumn("bps", F.coalesce("bps", F.lit(DEFAULT_BPS)))
    rows = rows.filter("bps > 0")
    return rows.agg(F.coalesce(F.sum(F.col("bytes").cast("double") / F.col("bps")), F.lit(0.0)).alias("serial_s"))


def amdahl(p: Column, jobs: Column) -> Column:
    return F.when(jobs <= 1, F.lit(1.0)).otherwise(F.lit(1.0) / ((F.lit(1.0) - p) + p / jobs))


def estimates(serial: DataFrame, jobs: DataFrame, p: float = PARALLEL_FRACTION) -> DataFrame:
    """Serial and parallel time, speed-up and efficiency for each number of jobs."""
    rows = serial.crossJoin(F.broadcast(jobs))  # a single row against a short list
    spent = F.col("serial_s") / amdahl(F.lit(p), F.col("jobs")) + F.greatest(F.lit(0), F.col("jobs") - 1) * WORKER_STARTUP
    rows = rows.withColumn("parallel_s", F.least("serial_s", spent))
    rows = rows.withColumn("speedup", F.when(F.col("parallel_s") > 0, F.col("serial_s") / F.col("parallel_s")).otherwise(1.0))
    return rows.withColumn("efficiency", F.col("speedup") / F.greatest(F.lit(1), F.col("jobs")))


def jobs_points(spark: SparkSession, most: int) -> DataFrame:
    """1, 2, 4, ... and ``most``."""
    powers = F.expr(f"transform(sequence(0, {max(0, most.bit_length() - 1)}), i -> shiftleft(1, i))")
    found = F.array_sort(F.array_distinct(F.concat(F.filter(powers, lambda n: n <= most), F.array(F.lit(most)))))
    return spark.range(1).select(F.explode(found).alias("jobs"))


def jobs_curve(shape: DataFrame, table: DataFrame, most: int, p: float = PARALLEL_FRACTION) -> DataFrame:
    return estimates(serial_seconds(shape, table), jobs_points(shape.sparkSession, most), p)


def measurement_points(cores: int) -> list[int]:
    """Job counts that a calibration tries: four at most."""
    points = [1 << i for i in range(4) if 1 << i <= cores]
    return sorted({*points, *([cores] if len(points) < 4 else [])})


def fit_amdahl(observations: DataFrame) -> DataFrame:
    """One row ``p``: the least squared error over 0.20..0.99; the smallest p among equals.

    ``observations``: ``jobs, seconds``; without a usable baseline the default fraction.
    """
    base = observations.filter("jobs = 1").agg(F.min("seconds").alias("base"))
    seen = observations.filter("jobs > 1 and seconds > 0").crossJoin(base).filter("base > 0")
    grid = observations.sparkSession.range(20, 100).select((F.col("id") / 100).alias("p"))
    error = F.pow(amdahl(F.col("p"), F.col("jobs")) - F.col("base") / F.col("seconds"), F.lit(2.0))
    # eighty grid points against a handful of measurements
    fits = seen.crossJoin(F.broadcast(grid)).groupBy("p").agg(F.sum(error).alias("err"))
    best = fits.agg(F.min_by("p", F.struct("err", "p")).alias("p"))
    return best.select(F.coalesce(F.round("p", 3), F.lit(PARALLEL_FRACTION)).alias("p"))


def speed_factor(expected_s: Column, measured_s: Column, overhead_s: Column) -> Column:
    """How fast this machine is against the baseline, within 0.05 and 5."""
    ratio = expected_s / F.greatest(F.lit(0.01), measured_s - overhead_s)
    return F.when(expected_s > 0, F.greatest(F.lit(0.05), F.least(F.lit(5.0), ratio))).otherwise(F.lit(1.0))


def recent_runs(runs: DataFrame, now: Column, days: int = RUN_DAYS, most: int = RUN_COUNT) -> DataFrame:
    """The last runs within the window; runs without a readable time are left out."""
    return runs.filter(F.col("ts").isNotNull() & (F.col("ts") >= now - F.expr(f"INTERVAL {days} DAYS"))).orderBy(F.desc("ts"), F.desc("run_id")).limit(most)


def aggregate_runs(runs: DataFrame, cores: int | None = None, version: str | None = None) -> DataFrame:
    """One row: compatible and skipped runs, seconds a byte as a ratio of sums, the corpora seen."""
    fits = F.lit(True)
    if cores is not None:
        fits = fits & F.col("cores").eqNullSafe(cores)
    if version is not None:
        fits = fits & F.col("version").eqNullSafe(version)
    spent = F.coalesce("mine_ms", F.lit(0.0)) + F.coalesce("finalize_ms", F.lit(0.0))
    counts = fits & (F.col("bytes") > 0) & (spent > 0)
    ms, size = F.sum(F.when(counts, spent)), F.sum(F.when(counts, F.col("bytes")))
    used = F.count_if(fits)
    return runs.agg(
        used.alias("runs_used"),
        F.count_if(~fits).alias("runs_skipped"),
        F.when(used >= LEAST_RUNS, ms / 1000.0 / size).alias("seconds_per_byte"),
        F.sort_array(F.collect_set(F.when(fits, F.col("root")))).alias("corpora"),
    )


def is_stale(version: Column, cores: Column, age: Column, now_version: str, now_cores: int, days: int = 90) -> Column:
    """Why a calibration no longer counts; null if it does."""
    return (
        F.when(version != now_version, "version")
        .when(cores != now_cores, "cores")
        .when(age >= days, "age")
    )


def _steps(value: Column, *steps: tuple[float, float], otherwise: Column | float) -> Column:
    """The result of the first step whose bound the value reaches."""
    (bound, result), *rest = steps
    chain = F.when(value >= bound, F.lit(result))
    for bound, result in rest:
        chain = chain.when(value >= bound, F.lit(result))
    return chain.otherwise(otherwise)


def coverage(shape: DataFrame, calibrated: list[str]) -> DataFrame:
    """One row: the share of bytes in languages that a calibration has measured."""
    known = F.sum(F.when(F.col("language").isin(*calibrated) if calibrated else F.lit(False), F.col("bytes")).otherwise(0))
    total = F.sum("bytes")
    return shape.agg(F.when(total > 0, known / total).otherwise(F.lit(0.0)).alias("coverage"))


def confidence_band(observed: Column, calibrated: Column, age: Column, covered: Column, runs: Column) -> tuple[Column, Column]:
    """Label and relative error of an estimate; the steps are fixed values.

    A cold run of the same corpus is nearly a measurement.  Without calibration only
    past runs narrow the band; with one, it depends on the languages that were
    measured, widens with age and narrows with runs.
    """
    plain = _steps(runs, (5, 0.25), (3, 0.40), otherwise=0.50)
    base = _steps(covered, (0.90, 0.15), (0.50, 0.25), otherwise=0.40)
    aged = F.when(age.isNull() | (age <= 30), 1.0).when(age <= 90, 1.2).otherwise(1.5)
    wide = F.least(F.lit(0.60), base * aged)
    narrowed = (
        F.when(runs >= 10, F.greatest(F.lit(0.08), wide * 0.5))
        .when(runs >= 5, F.greatest(F.lit(0.10), wide * 0.65))
        .when(runs >= 3, F.greatest(F.lit(0.12), wide * 0.80))
        .otherwise(wide)
    )
    error = F.when(observed, 0.05).when(~calibrated, plain).otherwise(narrowed)
    label = (
        F.when(observed, "high")
        .when(~calibrated, F.when(runs >= 5, "medium").otherwise("low"))
        .when(narrowed <= 0.18, "high")
        .when(narrowed <= 0.30, "medium")
        .otherwise("low")
    )
    return label, error


def report(curve: DataFrame, tail: Column | None = None, observed: float | None = None, hours: bool = True) -> DataFrame:
    """``at, text``: a line for each number of jobs, then what past runs say of mining, then a measured run.

    Without ``hours`` minutes count on past an hour.
    """
    rows = curve.select(
        F.col("jobs").cast("long").alias("at"),
        F.concat(
            F.format_string("jobs %d: ", F.col("jobs")), names.human_seconds("parallel_s", hours), F.format_string(", %.2f x", F.round("speedup", 2)),
            F.format_string(", efficiency %.0f %%", F.round(F.col("efficiency") * 100)),
        ).alias("text"),
    )
    one = curve.sparkSession.range(1)
    if tail is not None:
        mined = one.select(F.lit(1 << 40).alias("at"), F.concat(F.lit("mining, by past runs: "), names.human_seconds(tail, hours)).alias("text"))
        rows = rows.unionByName(mined.filter("text is not null"))
    if observed is not None:
        rows = rows.unionByName(one.select(F.lit(1 << 41).alias("at"), F.concat(F.lit("last full run: "), names.human_seconds(F.lit(observed), hours)).alias("text")))
    return rows


def languages_by_bytes(shape: DataFrame) -> DataFrame:
    return shape.orderBy(F.desc("bytes"), "language")


def synthetic_files(spark: SparkSession, n: int = 60) -> DataFrame:
    """Generated sources for a calibration without a corpus: ``path, content``."""
    body = F.concat_ws("\n", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.format_string("def step_%d_%d(value):\n    return check(value)\n", F.col("id"), i)))
    rows = spark.range(n)
    return rows.select(F.format_string("synthetic/mod_%03d.py", F.col("id")).alias("path"), F.encode(body, "UTF-8").alias("content"))
