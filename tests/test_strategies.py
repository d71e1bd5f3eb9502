import random

import pytest
from helpers import corpus, files, pairs

from lacuna.operators import closure, enrichment, series, symmetry


def methods(spark, classes):
    return corpus(spark, [("method", f"{f}::{c}.{m}", {}) for f, c, ms in classes for m in ms]).entities


def test_builtin_pair_reports_any_confidence(spark):
    e = methods(spark, [("a.py", "A", ["__enter__", "__exit__"]), ("b.py", "B", ["__enter__"])])
    found = symmetry.symmetry_gaps(e, auto_mine=False)
    (rule,) = found.rules.collect()
    assert (rule.group_id, rule.support_n, rule.support_total) == ("symmetry:context_manager", 1, 2)
    assert pairs(found) == [("symmetry:context_manager::symmetry=__exit__", "b.py::B.__enter__")]


def test_builtin_pair_is_directional(spark):
    assert symmetry.symmetry_gaps(methods(spark, [("a.py", "A", ["__exit__"])]), auto_mine=False).rules.count() == 0


def test_mined_pair(spark):
    e = methods(spark, [(f"{i}.py", "T", ["setUp", "tearDown"]) for i in range(5)] + [("x.py", "T", ["setUp"])])
    found = pairs(symmetry.symmetry_gaps(e))
    # the class and the file pair share an id; each reports its gap
    assert found == [("symmetry:mined:setUp_to_tearDown::symmetry=tearDown", "x.py::T.setUp")] * 2


def test_pair_below_support(spark):
    e = methods(spark, [(f"{i}.py", "T", ["setUp", "tearDown"]) for i in range(2)])
    assert symmetry.mine_pairs(e).count() == 0


def test_custom_pairs_replace_the_others(spark):
    e = methods(spark, [("a.py", "A", ["open", "__enter__"])])
    own = spark.createDataFrame([("res", "open", "close", "class", "")], symmetry.PAIR)
    assert pairs(symmetry.symmetry_gaps(e, own)) == [("symmetry:res::symmetry=close", "a.py::A.open")]


def test_call_pair(spark):
    rows = [("function", f"a.py::f{i}", {"calls": ["lock", "unlock"]}) for i in range(10)] + [("function", "a.py::g", {"calls": ["lock"]})]
    c = corpus(spark, rows)
    found = symmetry.call_pair_gaps(c.entities, c.values)
    (rule,) = found.rules.collect()
    assert (rule.support_n, rule.support_total) == (10, 11)
    assert pairs(found) == [("call_pair:lock::call_pair=unlock", "a.py::g")]


@pytest.mark.parametrize(
    ("names", "values"),
    [
        (["0001_a.py", "0002_b.py", "0004_c.py"], ["0003_*.py"]),
        (["0001_a.py", "0002_b.py", "0005_c.py"], ["0003_*.py", "0004_*.py"]),
        (["0001_a.py", "0002_b.py", "0003_c.py"], []),
        (["0001_a.py", "0003_c.py"], []),
        (["0001_a.py", "0002_b.py", "0004_c.py", "0900_z.py"], ["0003_*.py"]),
        (["1_a.py", "2_b.sql", "4_c.py"], ["3_*"]),
        (["9_a.py", "10_b.py", "12_c.py"], ["11_*.py"]),
    ],
)
def test_numbered_series(spark, names, values):
    found = series.series_gaps(files(spark, [f"m/{n}" for n in names]))
    assert sorted(r.feature_value for r in found.gaps.collect()) == values


def test_series_anchor_and_duplicate_support(spark):
    found = series.series_gaps(files(spark, ["m/0001_a.py", "m/0001_b.py", "m/0002_c.py", "m/0004_d.py"]))
    (gap,) = found.gaps.collect()
    assert (gap.entity_id, gap.support_n, gap.support_total, gap.confidence) == ("m/0002_c.py::f", 4, 4, 1.0)


def test_letter_and_version_series(spark):
    (gap,) = series.letter_series_gaps(files(spark, ["d/part_a.md", "d/part_b.md", "d/part_d.md"])).gaps.collect()
    assert (gap.group_id, gap.feature_value) == ("letter-series:d::part_", "part_c.md")
    paths = ["api_v1/x/a.py", "api_v2/a.py", "api_v4/b.py", "api_v4/a.py", "v1/a.py", "v3/a.py"]
    (gap,) = series.version_directory_gaps(files(spark, paths)).gaps.collect()
    assert (gap.group_id, gap.feature_value, gap.entity_id) == ("version-dir:.::api_", "api_v3", "api_v2/a.py::f")


def test_series_against_brute_force(spark):
    rnd = random.Random(4)
    paths = sorted({f"d{rnd.randrange(6)}/{rnd.randrange(40):03d}_{rnd.randrange(3)}.x" for _ in range(120)})
    expected = []
    for d in {p.split("/")[0] for p in paths}:
        rows = sorted((int(p.split("/")[1][:3]), p) for p in paths if p.startswith(d + "/"))
        clusters = []
        for n, p in rows:
            if clusters and n - clusters[-1][-1][0] <= 3:
                clusters[-1].append((n, p))
            else:
                clusters.append([(n, p)])
        for c in clusters:
            if len(rows) >= 3 and len(c) >= 3:
                for missing in set(range(c[0][0], c[-1][0])) - {n for n, _ in c}:
                    expected.append((f"series:{d}::series={missing:03d}_*.x", max(x for x in c if x[0] < missing)[1] + "::f"))
    assert pairs(series.series_gaps(files(spark, paths), max_gap=3)) == sorted(expected)


def ordinal(spark, cls, names):
    rows = [("class", f"a.py::{cls}", {})] + [("method", f"a.py::{cls}.{n}", {}) for n in names]
    return [(r.group_id, r.feature_value) for r in series.ordinal_series_gaps(corpus(spark, rows).entities).gaps.collect()]


@pytest.mark.parametrize(
    ("cls", "names", "found"),
    [
        ("TestUserCRUD", ["test_create", "test_read", "test_update"], [("ordinal:crud::a.py::TestUserCRUD", "test_delete")]),
        ("UserRepository", ["create", "findAll", "remove"], [("ordinal:crud::a.py::UserRepository", "update")]),
        ("Plain", ["create", "read", "update"], []),
        ("UserService", ["create", "read", "update", "delete"], []),
        ("UserService", ["create", "read"], []),
        ("Rank", ["first", "third"], [("ordinal:ordinal_three::a.py::Rank", "second")]),
    ],
)
def test_ordinal_series(spark, cls, names, found):
    assert ordinal(spark, cls, names) == found


def unused(spark, rows, texts=None):
    c = corpus(spark, rows)
    texts = spark.createDataFrame([(t,) for t in texts], "text string") if texts else None
    return [r.entity_id for r in closure.unused_class_gaps(c.entities, c.features, c.values, texts).gaps.orderBy("entity_id").collect()]


def test_unused_classes(spark):
    rows = [("class", f"a.py::{n}", {}) for n in ("Used", "Dotted", "Idle", "_Private")] + [("class", "tests/t.py::Case", {})]
    rows.append(("function", "b.py::f", {"calls": ["Used", "pkg.Dotted"]}))
    assert unused(spark, rows) == ["a.py::Idle"]
    assert unused(spark, rows, ["class Idle: pass"]) == ["a.py::Idle"]
    assert unused(spark, rows, ["class Idle: pass", "x = Idle"]) == []


def test_sibling_tests(spark):
    rows = [("function", "src/api/users.py::create", {}), ("function", "src/api/users.py::drop", {}), ("function", "src/api/users.py::_own", {})]
    rows += [("function", "tests/api/test_users.py::test_create", {}), ("method", "src/api/users.py::Foo._bar", {})]
    features, values = enrichment.sibling_tests(corpus(spark, rows).entities)
    assert {r.entity_id for r in features.collect()} == {"src/api/users.py::create", "src/api/users.py::drop", "src/api/users.py::Foo._bar"}
    assert [r.entity_id for r in values.collect()] == ["src/api/users.py::create"]


def test_entry_points(spark):
    rows = [("class", f"ext/{n}.py::{n.title()}", {"parent_class": ["ABC"] if n == "base" else []}) for n in ("go", "rust", "base")]
    c = corpus(spark, rows + [("class", "other/x.py::X", {})])
    registered = spark.createDataFrame([("ext/go.py", "Go")], "suffix string, class string")
    features, values = enrichment.entry_points(c.entities, c.values, registered)
    assert sorted(r.entity_id for r in features.collect()) == ["ext/go.py::Go", "ext/rust.py::Rust"]
    assert [r.entity_id for r in values.collect()] == ["ext/go.py::Go"]
