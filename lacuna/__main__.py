"""``python -m lacuna check|est|suppress|purge``: the engine from a shell."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from collections.abc import Iterable
from contextlib import nullcontext
from dataclasses import replace
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import names
from .operators import estimator, finalize
from .plans import scan
from .sinks import reports
from .sources import calibration, config, extract, files, state

SETTINGS = Path.home() / ".lacuna" / "settings.json"
UNSET = {"jobs_default": None, "default_export_path": None}


def _config(args: argparse.Namespace) -> config.Config:
    found = Path(args.config) if args.config else config.find_config(Path(args.path).resolve())
    chosen = (config.from_file(found) if found else config.Config()).overridden(args.language, args.exclude)
    own = {k: v for k in ("min_confidence", "min_group_size") if (v := getattr(args, k, None)) is not None}
    return replace(chosen, **own)


def _state(args: argparse.Namespace) -> str:
    return f"{args.path.rstrip('/') or '.'}/{state.STATE}"


def _store(spark: SparkSession, args: argparse.Namespace) -> state.StateStore:
    return state.StateStore(spark, _state(args))


def _documents(result: scan.ScanResult, kind: str, root: str, statistics: dict, known: dict) -> Iterable[str]:
    gaps, entities = result.gaps, result.corpus.entities
    if kind == "sarif":
        return reports.sarif_chunks(gaps, entities, root)
    if kind == "json":
        return reports.json_chunks(gaps, entities, statistics, reports.metadata(root, statistics, gaps, **known))
    if kind == "csv":
        return reports.csv_chunks(gaps, entities)
    return [{"text": reports.text, "markdown": reports.markdown, "html": reports.page}[kind](gaps, entities)]


def _target(output: str | None, kind: str) -> Path | None:
    """Where a report goes: a file, or a file of its kind in a folder; None is standard output."""
    if output is None:
        return None
    where = Path(output or config.json_settings(SETTINGS, UNSET)["default_export_path"] or ".").expanduser()
    return reports.export_path(str(where), "gaps", kind) if where.is_dir() else where


def check(spark: SparkSession, args: argparse.Namespace) -> int:
    """Incremental scan; prints or writes a report and exits 1 where there are gaps."""
    chosen, store, registry = _config(args), _store(spark, args), extract.Registry.discover()
    kind = "json" if args.json else args.report
    began, started = time.time(), datetime.now(UTC)
    run_id = started.strftime("%Y%m%dT%H%M%S%fZ")
    with store.lock():
        store.begin_run(run_id, root=args.path)
        cold = ["."] if args.cold == [] else args.cold  # the flag alone: everything
        result, fresh = scan.rescan(spark, args.path, store, chosen, registry, cold)
        parsed = time.time()
        statistics = result.statistics().head().asDict()
        known = {
            "started_at": started.isoformat(), "duration_ms": 1000 * (time.time() - began),
            "suppressed": result.every.count() - statistics["gaps"],
            "min_confidence": chosen.min_confidence, "min_group_size": chosen.min_group_size,
        }
        target = _target(args.output, kind)
        if target or not args.quiet:
            with target.open("w") if target else nullcontext(sys.stdout) as out:
                for part in _documents(result, kind, args.path, statistics, known):
                    out.write(part)
        now = registry.with_language(files.listed(spark, args.path, excludes=list(chosen.exclude)), list(chosen.languages) or None)
        sizes = {r.language: r.bytes for r in files.corpus_shape(now).collect()}
        cores = spark.sparkContext.defaultParallelism
        record = {"ts": started.isoformat(), "version": calibration.VERSION, "cores": cores, "jobs": args.jobs or cores, "root": args.path}
        record |= {"files_unchanged": fresh.files - fresh.changed, "by_language_bytes": sizes, "duration_ms": 1000 * (time.time() - began)}
        record |= {"stage_ms": {"parse": 1000 * (parsed - began), "mine": 1000 * (time.time() - parsed)}} | statistics
        store.end_run(run_id, record)
        store.folder.write(LAST_RUN, json.dumps({"run_id": run_id} | record, indent=2))
        result.release()
    return finalize.exit_code(statistics["gaps"], args.max_gaps)


LAST_RUN, CALIBRATION = "last_run.json", "calibration.json"


def _observed(text: str | None) -> float | None:
    """Seconds of the last run, if it read every file."""
    try:
        last = json.loads(text or "")
        return float(last["duration_ms"]) / 1000 if last["files_unchanged"] == 0 else None
    except (ValueError, TypeError, KeyError):
        return None


def est(spark: SparkSession, args: argparse.Namespace) -> int:
    """How long a cold scan would take at several degrees of parallelism, and how sure that is."""
    chosen, registry = _config(args), extract.Registry.discover()
    folder, cores = state.Folder(spark, _state(args)), spark.sparkContext.defaultParallelism
    known = None if args.recalibrate else calibration.Calibration.parse(folder.read(CALIBRATION))
    if args.recalibrate:
        known = calibration.calibrate(spark, None if args.use_synthetic else args.path)
        folder.write(CALIBRATION, known.text())
    shape = files.corpus_shape(registry.with_language(files.listed(spark, args.path, excludes=list(chosen.exclude)), list(chosen.languages) or None)).cache()
    table = estimator.bps_table(spark, known.speed_factor if known else 1.0, known.bps if known else None)
    p = known.parallel_fraction if known else estimator.PARALLEL_FRACTION
    runs = config.run_log(spark, folder.path(state.RUNS)) if folder.exists(state.RUNS) else config.no_runs(spark)
    past = estimator.aggregate_runs(estimator.recent_runs(runs, F.current_timestamp()), cores, calibration.VERSION).head()
    made = F.lit(known.calibrated_at if known else None).cast("timestamp")
    age = names.age_days(made, F.current_timestamp())
    stale = estimator.is_stale(F.lit(known.version if known else None), F.lit(known.cores if known else None), age, calibration.VERSION, cores)
    observed = _observed(folder.read(LAST_RUN))
    jobs = args.jobs or cores
    curve = estimator.jobs_curve(shape, table, jobs, p)
    tail = F.lit(past.seconds_per_byte) * F.lit(shape.agg(F.sum("bytes")).head()[0] or 0) if past.seconds_per_byte is not None else F.lit(None).cast("double")
    for line in estimator.report(curve, tail, observed).orderBy("at").collect():
        print(line.text)
    covered = estimator.coverage(shape, known.languages if known else [])
    label, error = estimator.confidence_band(F.lit(observed is not None), F.lit(known is not None), age, F.col("coverage"), F.lit(past.runs_used))
    row = covered.select(label.alias("label"), error.alias("error"), stale.alias("stale")).head()
    print(f"confidence: {row.label}, +-{row.error:.0%}, {past.runs_used} runs counted" + (f"; calibration is stale: {row.stale}" if row.stale else ""))
    if args.history:
        for row in state.latest_runs(runs, 30).collect():
            print(row.ts, row.bytes, row.mine_ms)
    shape.unpersist()
    return 0


def suppress(spark: SparkSession, args: argparse.Namespace) -> int:
    store = _store(spark, args)
    with store.lock():
        if args.gap and args.remove:
            store.unsuppress(args.gap)
        elif args.gap:
            whole = args.gap if "::" in args.gap else None
            short = F.lit(args.gap) if whole is None else names.short_id(F.lit(whole))
            row = spark.range(1).select(
                short.alias("short_id"),
                F.lit(whole).cast("string").alias("full_id"), F.lit(args.reason).alias("reason"), F.current_timestamp().alias("created_at"),
            )
            store.suppress(row)
        else:
            for row in store.read("suppressions", scan.SUPPRESSION).orderBy("short_id").collect():
                print(row.short_id, row.reason)
    return 0


def purge(spark: SparkSession, args: argparse.Namespace) -> int:
    """Delete a project's state, or with ``--all`` that of every project below; only ``--yes`` deletes those."""
    if not args.all:
        _store(spark, args).purge()
        return 0
    for found in state.state_folders(Path(args.path), files.NOISE_DIRECTORIES):
        print(f"{'deleted' if args.yes else 'found'} {found}")
        if args.yes:
            state.StateStore(spark, str(found)).purge()
    return 0


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="lacuna")
    commands = top.add_subparsers(required=True)
    for run in (check, est, suppress, purge):
        c = commands.add_parser(run.__name__)
        c.set_defaults(run=run)
        if run is suppress:
            c.add_argument("gap", nargs="?")
            c.add_argument("--reason", default="")
            c.add_argument("--remove", action="store_true")
            c.add_argument("--path", default=".")
            continue
        c.add_argument("path", nargs="?", default=".")
        c.add_argument("--config")
        c.add_argument("--language")
        c.add_argument("--exclude", action="append")
        if run is check:
            c.add_argument("--report", choices=["text", "markdown", "html", "json", "csv", "sarif"], default="text")
            c.add_argument("--json", action="store_true")
            c.add_argument("--output", nargs="?", const="", help="file or folder; without a value the folder of the settings")
            c.add_argument("--min-confidence", type=float)
            c.add_argument("--min-group-size", type=int)
            c.add_argument("--cold", nargs="*", default=None)
            c.add_argument("--max-gaps", type=int)
            c.add_argument("--quiet", action="store_true")
        if run is est:
            c.add_argument("--recalibrate", action="store_true")
            c.add_argument("--use-synthetic", action="store_true")
            c.add_argument("--history", action="store_true")
        if run in (check, est):
            c.add_argument("--jobs", "-j", type=int, help="tasks at once, where this command starts Spark on one machine")
        if run is purge:
            c.add_argument("--all", action="store_true")
            c.add_argument("--yes", action="store_true")
    args = top.parse_args(argv)
    if os.path.isdir(args.path):  # the JVM has a working directory of its own
        args.path = os.path.abspath(args.path)
    builder = SparkSession.builder.appName("lacuna").config("spark.sql.session.timeZone", "UTC")
    if "jobs" in args:
        args.jobs = args.jobs or config.json_settings(SETTINGS, UNSET)["jobs_default"]
        if args.jobs and SparkSession.getActiveSession() is None and "MASTER" not in os.environ:
            builder = builder.master(f"local[{args.jobs}]")
    spark = builder.getOrCreate()
    try:
        return args.run(spark, args)
    except (state.StateLockedError, state.StateVersionError, OSError, ValueError) as e:
        print(f"lacuna: {e}", file=sys.stderr)
        return finalize.exit_code(0, error=True)


if __name__ == "__main__":
    sys.exit(main())
