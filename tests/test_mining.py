import hashlib

import pytest
from helpers import corpus, pairs

from lacuna.operators import finalize, frequency, selectors


def mined(c, members=None, **kw):
    members = members if members is not None else selectors.directory_groups(c.entities)
    return frequency.mine(members, c.features, c.values, **kw)


def audit(n, have):
    return [("function", f"api/users.py::f{i}", {"decorator": ["@audit"] if i < have else []}) for i in range(n)]


def test_threshold_met(spark):
    found = mined(corpus(spark, audit(5, 4)))
    (rule,) = found.rules.collect()
    assert (rule.support_n, rule.support_total, rule.confidence) == (4, 5, 0.8)
    (gap,) = found.gaps.collect()
    assert gap.gap_id == "directory::api::decorator=@audit::api/users.py::f4"
    assert gap.short_id == "g-" + hashlib.sha256(gap.gap_id.encode()).hexdigest()[:7]


@pytest.mark.parametrize(("n", "have", "rules", "gaps"), [(5, 3, 0, 0), (3, 3, 1, 0), (2, 2, 0, 0)])
def test_thresholds(spark, n, have, rules, gaps):
    found = mined(corpus(spark, audit(n, have)))
    assert (found.rules.count(), found.gaps.count()) == (rules, gaps)


def test_two_rules_in_one_group(spark):
    rows = [("function", f"a/x.py::{n}", {"decorator": ["@x"] + ["@y"] * (n != "e")}) for n in "abcde"]
    assert pairs(mined(corpus(spark, rows))) == [("directory::a::decorator=@y", "a/x.py::e")]


def test_absent_kind_is_not_an_empty_one(spark):
    rows = [("class", f"a/x.py::C{i}", {"parent_class": ["Base"]}) for i in range(3)]
    rows += [("function", f"a/x.py::f{i}", {"decorator": []}) for i in range(2)]
    found = mined(corpus(spark, rows))
    (rule,) = found.rules.collect()
    assert (rule.support_n, rule.support_total) == (3, 3)


def test_group_is_not_its_own_finding(spark):
    rows = [("function", f"a{i}/x.py::f", {"decorator": ["@audit"] + ["@route"] * (i < 4)}) for i in range(5)]
    c = corpus(spark, rows)
    found = mined(c, selectors.decorator_groups(c.values))
    assert pairs(found) == [("decorator::@audit::decorator=@route", "a4/x.py::f")]


def test_a_base_class_need_not_extend_itself(spark):
    rows = [("class", "a/b.py::Base", {"parent_class": []})] + [("class", f"a/b.py::C{i}", {"parent_class": ["Base"]}) for i in range(4)]
    found = mined(corpus(spark, rows))
    assert found.rules.count() == 1 and found.gaps.count() == 0


def test_rare_values_are_pruned_only_at_full_confidence(spark):
    rows = [("function", f"a/x.py::f{i}", {"calls": ["once"]} if i == 0 else {}) for i in range(3)]
    c = corpus(spark, rows)
    assert mined(c).rules.count() == 1
    assert mined(c, min_confidence=1.0).rules.count() == 0


def test_directories_take_functions_classes_and_modules(spark):
    c = corpus(spark, [("method", f"a/x.py::C.m{i}", {}) for i in range(3)] + [("function", f"x{i}.py::f", {}) for i in range(3)])
    assert {r.group_id for r in selectors.directory_groups(c.entities).collect()} == {"directory::<root>"}


def test_parent_groups_overlap(spark):
    c = corpus(spark, [("class", f"a.py::C{i}", {"parent_class": ["A", "B", "object"]}) for i in range(3)])
    found = selectors.parent_class_groups(c.entities, c.values)
    assert sorted((r.name, r.n_members) for r in selectors.groups(found).collect()) == [("A", 3), ("B", 3)]


def test_empty_corpus(spark):
    found = mined(corpus(spark, []))
    assert found.rules.count() == 0 and found.gaps.count() == 0


def test_dedup_keeps_the_surest_then_the_earliest(spark):
    rows = [("function", f"a/x.py::f{i}", {"decorator": ["@g", "@x"] if i < 8 else ["@g"] if i < 9 else []}) for i in range(10)]
    c = corpus(spark, rows)
    members = selectors.union_groups(selectors.directory_groups(c.entities), selectors.decorator_groups(c.values))
    gaps = finalize.dedup_gaps(mined(c, members).gaps).collect()
    best = {(g.entity_id, g.feature_value): g.group_id for g in gaps}
    assert best["a/x.py::f8", "@x"] == "decorator::@g"  # 8/9 against 8/10
    assert best["a/x.py::f9", "@x"] == "directory::a"


@pytest.mark.parametrize(("n", "allowed", "error", "code"), [(0, None, False, 0), (1, None, False, 1), (2, 2, False, 0), (3, 2, False, 1), (0, None, True, 2)])
def test_exit_codes(n, allowed, error, code):
    assert finalize.exit_code(n, allowed, error) == code
