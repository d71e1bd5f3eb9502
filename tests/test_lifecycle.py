import json
from pathlib import Path

import pytest
from helpers import corpus, pairs
from pyspark.sql import functions as F

from lacuna.functions import names
from lacuna.operators import estimator, finalize, selectors, views
from lacuna.plans import scan
from lacuna.sinks import reports, tables
from lacuna.sources import config, extract, files, state
from lacuna.streaming import watch


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "api").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.js").write_text("function no() {}")
    body = "".join(f"{'@audit' if i else ''}\ndef f{i}(a):\n    pass\n\n" for i in range(5))
    (tmp_path / "api" / "users.py").write_text(body)
    (tmp_path / "api" / "notes.txt").write_text("not a source")
    return tmp_path


def test_scan_of_a_tree(spark, tree):
    result = scan.scan_tree(spark, str(tree))
    missing = [r.entity_id for r in result.gaps.filter("feature_value = '@audit'").collect()]
    assert missing == ["api/users.py::f0"]
    assert result.corpus.entities.count() == 6
    row = result.statistics().head()
    assert (row.entities, row.files) == (6, 1)
    result.register(spark, "t_")
    assert spark.sql("SELECT count(*) c FROM t_gaps").head().c == result.gaps.count()
    result.release()


def test_suppressions_come_after_dedup(spark, tree):
    (tree / "lacuna.toml").write_text('[[suppress]]\nentity = "api/users.py::f0"\nrule = "@audit"\n')
    result = scan.scan_tree(spark, str(tree))
    assert result.gaps.filter("feature_value = '@audit'").count() == 0
    result.release()
    (tree / "lacuna.toml").write_text("not toml [")
    assert config.project_suppressions(spark, tree).count() == 0


def test_incremental_state(spark, tree, tmp_path_factory):
    store = state.StateStore(spark, str(tmp_path_factory.mktemp("state") / "s"))
    registry, counts = extract.Registry(), []

    def refresh():
        now = registry.with_language(files.source_files(spark, str(tree)))
        found = scan.refresh(spark, now, store, registry)
        counts.append((found.files, found.changed))
        return {r.entity_id for r in found.rows.collect()}

    assert len(refresh()) == 6
    (tree / "api" / "more.py").write_text("def g(): pass\n")
    assert "api/more.py::g" in refresh()
    (tree / "api" / "users.py").unlink()
    assert refresh() == {"api/more.py::__module__", "api/more.py::g"}
    for name in "abc":
        (tree / "api" / f"{name}.py").write_text(f"def {name}(): pass\n")
    refresh()
    (tree / "api" / "a.py").write_text("def other(): pass\n")
    assert "api/a.py::other" in refresh() and "api/a.py::a" not in refresh()
    assert counts == [(1, 1), (2, 1), (1, 0), (4, 3), (4, 1), (4, 0)]
    with store.lock(), pytest.raises(state.StateLockedError), store.lock():
        pass
    store.folder.write("version", "99")
    with pytest.raises(state.StateVersionError):
        state.StateStore(spark, store.root)
    store.purge()
    assert not store.folder.exists()


def test_watch_takes_what_is_there(spark, tree, tmp_path_factory):
    base = tmp_path_factory.mktemp("watch")
    seen = []
    store = state.StateStore(spark, str(base / "s"))
    query = watch.watch(spark, str(tree), store, lambda r, n: seen.append(r.gaps.filter("feature_value = '@audit'").count()), checkpoint=str(base / "c"), once=True)
    query.awaitTermination(120)
    assert seen == [1]


def test_suppression_store(spark, tmp_path):
    store = state.StateStore(spark, str(tmp_path / "s"))
    row = spark.sql("SELECT 'g-1' short_id, 'full' full_id, 'why' reason, current_timestamp() created_at")
    store.suppress(row)
    store.suppress(row.withColumn("reason", F.lit("because")))
    schema = "short_id string, full_id string, reason string, created_at timestamp"
    assert [r.reason for r in store.read("suppressions", schema).collect()] == ["because"]
    store.unsuppress("g-1")
    assert store.read("suppressions", schema).count() == 0


def test_last_definition_wins_at_the_first_place(spark):
    rows = [("a::x", "method", "a::x", "a", 3, 1, {"calls": ["old"]}), ("a::x", "method", "a::x", "a", 9, 4, {"calls": ["new"]})]
    from lacuna.schema import EXTRACTED

    (row,) = state.last_definitions(spark.createDataFrame(rows, EXTRACTED)).collect()
    assert (row.line, row.ordinal, row.features) == (9, 1, {"calls": ["new"]})


@pytest.mark.parametrize(
    ("pattern", "path", "hit"),
    [
        ("**/vendor/**", "a/vendor/b.c", True),
        ("**/vendor/**", "vendor/b.c", True),
        ("*.test.py", "a/x.test.py", False),
        ("**/*.test.py", "a/x.test.py", True),
        ("build/**", "build/x/y.c", True),
        ("a?[!b].py", "aac.py", True),
        ("a?[!b].py", "aab.py", False),
    ],
)
def test_globs(spark, pattern, path, hit):
    rows = spark.createDataFrame([(path,)], "path string")
    assert files.scan_filter(rows, excludes=[pattern], noise=["none"]).isEmpty() is hit


def test_names(spark):
    rows = spark.createDataFrame([("a/b.py::C.m", "method"), ("x.py::f", "function"), ("a.py::m", "method"), ("plain", "class")], "q string, kind string")
    found = rows.select(names.short_name("q"), names.class_scope("kind", "q"), names.bare_class_name("q")).collect()
    assert [tuple(r) for r in found] == [("m", "a/b.py::C", "m"), ("f", None, "f"), ("m", None, "m"), ("plain", None, "")]
    paths = spark.createDataFrame([("src/api/users.py",), ("x.py",), (".env",)], "p string")
    found = [r[0] for r in paths.select(names.candidate_test_files("p")).collect()]
    assert found[0] == [f"{d}/{n}" for d in ("tests/api", "tests/src/api", "tests", "src/api") for n in ("test_users.py", "users_test.py")]
    assert found[1] == ["tests/test_x.py", "tests/x_test.py", "test_x.py", "x_test.py"]
    words = spark.createDataFrame([("é a_1 9x _b-c",)], "t string")
    assert words.select(names.identifiers("t")).head()[0] == ["a_1", "_b", "c"]


def test_config(tmp_path):
    (tmp_path / "lacuna.toml").write_text('[scan]\nexclude = ["x/**"]\nlanguages = ["go"]\n[mining]\nmin_confidence = 0.9\n[selectors.decorator]\nenabled = false\n')
    (tmp_path / "a").mkdir()
    found = config.from_file(config.find_config(tmp_path / "a"))
    assert (found.min_confidence, found.decorator.enabled, found.directory.enabled) == (0.9, False, True)
    other = found.overridden(languages=" c, ,rust", exclude=["y"])
    assert other.languages == ("c", "rust") and other.exclude == ("x/**", "y")
    assert config.json_settings(tmp_path / "none", {"jobs_default": 3}) == {"jobs_default": 3}
    (tmp_path / "s.json").write_text('{"jobs_default": 0, "other": 1}')
    assert config.json_settings(tmp_path / "s.json", {"jobs_default": None}) == {"jobs_default": None}


def test_entry_point_source(spark, tmp_path):
    (tmp_path / "pyproject.toml").write_text('[project.entry-points."x.y"]\ngo = "pkg.ext.go:GoThing"\nbad = "nothing"\n')
    assert [tuple(r) for r in config.registered_entry_points(spark, tmp_path).collect()] == [("pkg/ext/go.py", "GoThing")]


def test_run_log(spark, tmp_path):
    rows = [{"run_id": str(i), "ts": f"2024-01-{i:02d}T00:00:00+00:00", "cores": 8, "version": "1", "root": "r", "by_language_bytes": {"c": 100, "go": i}, "stage_ms": {"mine": 10.0, "finalize": 1.0}} for i in (1, 2, 3)]
    (tmp_path / "runs.jsonl").write_text("\n".join([*map(json.dumps, rows), "{broken", json.dumps({"run_id": "9", "ts": "never"})]))
    runs = config.run_log(spark, str(tmp_path / "runs.jsonl"))
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    recent = estimator.recent_runs(runs, now)
    assert [r.run_id for r in recent.collect()] == ["3", "2", "1"]
    (row,) = estimator.aggregate_runs(recent, 8, "1").collect()
    assert (row.runs_used, row.runs_skipped, row.corpora) == (3, 0, ["r"])
    assert row.seconds_per_byte == pytest.approx(0.033 / 306)
    (row,) = estimator.aggregate_runs(recent, 4).collect()
    assert (row.runs_used, row.runs_skipped, row.seconds_per_byte) == (0, 3, None)


def test_amdahl(spark):
    true_p = 0.7
    seen = [(n, 100 * ((1 - true_p) + true_p / n)) for n in (1, 2, 4, 8)]
    assert estimator.fit_amdahl(spark.createDataFrame(seen, "jobs int, seconds double")).head().p == pytest.approx(0.7)
    assert estimator.fit_amdahl(spark.createDataFrame([(2, 1.0)], "jobs int, seconds double")).head().p == 0.55
    assert estimator.measurement_points(6) == [1, 2, 4, 6] and estimator.measurement_points(32) == [1, 2, 4, 8]
    assert [r.jobs for r in estimator.jobs_points(spark, 12).collect()] == [1, 2, 4, 8, 12]
    assert estimator.synthetic_files(spark, 3).count() == 3


def test_reports(spark):
    rows = [("function", f"a/x|y.py::f{i}", {"decorator": ["@<x>"] if i < 4 else []}) for i in range(5)]
    c = corpus(spark, rows)
    found = scan.scan_corpus(c)
    gaps, entities = found.gaps, c.entities
    document = json.loads(reports.json_document(gaps, entities, {"rules": 1}))
    assert document["summary"] == {"gaps": 1, "rules": 1} and document["gaps"][0]["rule"]["confidence"] == 0.8
    sarif = json.loads(reports.sarif_document(gaps, entities, "/tmp"))
    (result,) = sarif["runs"][0]["results"]
    assert (sarif["version"], result["ruleIndex"], result["level"]) == ("2.1.0", 0, "note")
    assert "&lt;x&gt;" in reports.page(gaps, entities) and "x\\|y.py" in reports.markdown(gaps, entities)
    assert "1 gaps shown" in reports.text(gaps, entities)
    assert reports.export_path("out", "scan", "sarif") == Path("out/scan.sarif")
    assert tables.csv_rows(gaps, entities).head().confidence == "0.8000"
    found.release()


def test_views(spark):
    rows = [("function", f"a/x.py::f{i}", {"decorator": ["@x"] if i < 4 else []}) for i in range(5)]
    c = corpus(spark, rows)
    members = selectors.directory_groups(c.entities)
    found = scan.scan_corpus(c)
    detail = views.rule_detail(members, c.features, c.values, found.rules.filter("feature_value = '@x'"))
    assert sorted(r.exhibits for r in detail.collect()) == [False] + [True] * 4
    assert pairs(found)[-1][1] == "a/x.py::f4"
    assert finalize.rules_by_id(found.rules).count() == found.rules.count()
    found.release()


def test_command_line(spark, tree, capsys, monkeypatch):
    from lacuna.__main__ import main

    assert main(["check", str(tree), "--report", "json"]) == 1
    gaps = json.loads(capsys.readouterr().out)["gaps"]
    (gap,) = [g for g in gaps if g["rule"]["feature_value"] == "@audit"]
    assert main(["suppress", gap["short_id"], "--reason", "known", "--path", str(tree)]) == 0
    main(["check", str(tree), "--report", "json"])
    assert gap["id"] not in capsys.readouterr().out
    assert main(["check", str(tree), "--quiet", "--max-gaps", "99"]) == 0
    assert main(["check", str(tree), "--quiet", "--max-gaps", "99", "--cold"]) == 0
    assert main(["est", str(tree), "--recalibrate", "--use-synthetic", "--history"]) == 0
    shown = capsys.readouterr().out
    assert "confidence: high, +-5%, 4 runs counted" in shown and "last full run: " in shown and "mining, by past runs: " in shown
    assert main(["check", str(tree), "--config", "/nowhere.toml"]) == 2
    assert main(["check", str(tree), "--output", str(tree), "--report", "csv"]) == 0  # the one gap is suppressed
    assert (tree / "gaps.csv").read_text().startswith("gap_id,short_id,")
    capsys.readouterr()
    assert main(["check", str(tree), "--json", "--min-confidence", "1.0"]) in (0, 1)
    document = json.loads(capsys.readouterr().out)
    assert document["meta"]["min_confidence"] == 1.0 and document["meta"]["gaps_total"] == len(document["gaps"]) == document["summary"]["gaps"]
    assert document["meta"]["files_seen"] == 1 and document["meta"]["suppressed"] == 0
    assert main(["purge", str(tree), "--all"]) == 0 and (tree / ".lacuna").exists()
    assert main(["purge", str(tree), "--all", "--yes"]) == 0 and not (tree / ".lacuna").exists()
    monkeypatch.chdir(tree)
    capsys.readouterr()  # what purge said
    assert main(["check", "--json"]) == 1
    assert json.loads(capsys.readouterr().out)["gaps"][0]["entity"]["file_path"] == "api/users.py"
    assert main(["purge"]) == 0 and not (tree / ".lacuna").exists()


def test_settings_and_targets(tmp_path, monkeypatch):
    from lacuna import __main__ as command

    monkeypatch.setattr(command, "SETTINGS", tmp_path / "settings.json")
    assert command._target(None, "csv") is None and command._target("x.json", "json") == Path("x.json")
    (tmp_path / "settings.json").write_text(json.dumps({"default_export_path": str(tmp_path)}))
    assert command._target("", "sarif") == tmp_path / "gaps.sarif"


def test_run_records(spark, tmp_path):
    store = state.StateStore(spark, str(tmp_path / "s"))
    store.begin_run("r1", root="a")
    store.begin_run("r2", root="a")
    done = {"ts": "2024-01-02T00:00:00+00:00", "cores": 4, "version": "1", "root": "a", "by_language_bytes": {"c": 10}, "stage_ms": {"mine": 5.0}}
    store.end_run("r2", done)
    runs = config.run_log(spark, store.folder.path(state.RUNS))
    assert {r.run_id: r.ts is None for r in runs.collect()} == {"r1": True, "r2": False}
    recent = estimator.recent_runs(runs, F.lit("2024-02-01 00:00:00").cast("timestamp"))
    assert [r.run_id for r in recent.collect()] == ["r2"]


def test_locks_elsewhere(spark, tmp_path, monkeypatch):
    """Where the system can't lock, only one process creates the lock file."""
    store = state.StateStore(spark, str(tmp_path / "s"))
    monkeypatch.setattr(state.Folder, "local", lambda self: None)
    with store.lock(), pytest.raises(state.StateLockedError), store.lock():
        pass
    with store.lock():
        pass
    assert not store.folder.exists(state.LOCK)


def test_human_seconds(spark):
    rows = spark.createDataFrame([(45.23,), (192.9,), (3860.0,)], "s double").select(names.human_seconds("s"))
    assert [r[0] for r in rows.collect()] == ["45.2 s", "3 m 12 s", "1 h 4 m"]
