import json

from helpers import corpus
from lacuna.plans import scan
from lacuna.sinks import reports


def test_exports_hold_every_gap(spark):
    """More gaps than a report shows, under two rules."""
    n = reports.SHOWN + 50
    paths = [f"{d}/x.py::f{i}" for d in "ab" for i in range(5)]
    c = corpus(spark, [("function", p, {"decorator": ["@x"] if not p.endswith("4") else []}) for p in paths])
    found = scan.scan_corpus(c)
    few = found.gaps.filter("feature_value = '@x'")
    copies = spark.range(n // 2).withColumnRenamed("id", "copy")
    gaps = few.crossJoin(copies).selectExpr(
        *[f"concat({x}, '-', copy) AS {x}" if x in ("gap_id", "short_id") else f"`{x}`" for x in few.columns]
    ).cache()
    total, rules = gaps.count(), {r.rule_id for r in few.collect()}
    assert total > reports.SHOWN and len(rules) > 1
    document = json.loads(reports.json_document(gaps, c.entities, {"rules": 2}))
    assert document["summary"]["gaps"] == total == len({g["id"] for g in document["gaps"]})
    (run,) = json.loads(reports.sarif_document(gaps, c.entities, "/tmp"))["runs"]
    described = run["tool"]["driver"]["rules"]
    assert len(run["results"]) == total and {r["id"] for r in described} == rules
    assert all(described[r["ruleIndex"]]["id"] == r["ruleId"] for r in run["results"])
    for render in (reports.text, reports.markdown, reports.page):
        assert f"{reports.SHOWN} gaps shown, {total} in all" in render(gaps, c.entities)
    none = reports.json_document(gaps.limit(0), c.entities, {"rules": 0})
    assert none == json.dumps({"scan": {"rules": 0}, "summary": {"gaps": 0, "rules": 0}, "gaps": []}, indent=2) + "\n"
    assert json.dumps(document, indent=2, ensure_ascii=False) + "\n" == reports.json_document(gaps, c.entities, {"rules": 2})
    found.release()
