"""Findings as documents for people and tools.

Text, Markdown and HTML show the most confident ``SHOWN`` gaps and say how many there
are; JSON and SARIF hold every gap and are streamed, a partition at a time.
"""

from __future__ import annotations

import csv
import html
import io
import itertools
import json
import textwrap
import uuid
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import CSV_COLUMNS, csv_rows, json_rows, located, sarif_results

#: Rows that a report for people shows.
SHOWN = 10_000
TOOL, VERSION = "lacuna", "1"
EXTENSIONS = {"markdown": ".md", "html": ".html", "text": ".txt", "json": ".json", "csv": ".csv", "sarif": ".sarif"}


def export_path(folder: str, name: str, kind: str) -> Path:
    return Path(folder) / f"{name}{EXTENSIONS[kind]}"


def _rows(gaps: DataFrame, entities: DataFrame, limit: int) -> list:
    return located(gaps, entities).orderBy(F.desc("confidence"), "strategy_ord", "emit", "entity_id").limit(limit).collect()


def _shown(rows: list, gaps: DataFrame) -> str:
    return f"{len(rows)} gaps shown, {gaps.count()} in all"


def _sentence(r) -> str:
    return f"missing {r.feature_value} ({r.feature_kind}; {r.support_n} of {r.support_total} in {r.group_id}, {r.confidence:.2f})"


def text(gaps: DataFrame, entities: DataFrame, limit: int = SHOWN) -> str:
    rows = _rows(gaps, entities, limit)
    body = [f"{r.short_id}  {r.file_path}:{r.line}  {r.qualified_name}  {_sentence(r)}" for r in rows]
    return "\n".join([*body, _shown(rows, gaps), ""])


def markdown(gaps: DataFrame, entities: DataFrame, limit: int = SHOWN) -> str:
    rows = _rows(gaps, entities, limit)

    def cell(x) -> str:
        return str(x).replace("|", "\\|").replace("\n", " ")

    head = ["# Gaps", "", "| id | where | what | finding |", "|---|---|---|---|"]
    body = [f"| `{r.short_id}` | {cell(r.file_path)}:{r.line} | `{cell(r.qualified_name)}` | {cell(_sentence(r))} |" for r in rows]
    return "\n".join([*head, *body, "", _shown(rows, gaps), ""])


def page(gaps: DataFrame, entities: DataFrame, limit: int = SHOWN) -> str:
    rows = _rows(gaps, entities, limit)
    body = "".join(
        f"<tr><td><code>{r.short_id}</code></td><td>{html.escape(r.file_path)}:{r.line}</td>"
        f"<td><code>{html.escape(r.qualified_name)}</code></td><td>{html.escape(_sentence(r))}</td></tr>\n"
        for r in rows
    )
    return f"<!doctype html>\n<meta charset='utf-8'><title>Gaps</title>\n<h1>Gaps</h1>\n<table>\n{body}</table>\n<p>{_shown(rows, gaps)}</p>\n"


def _filled(document: dict, lists: dict[str, Iterable]) -> Iterator[str]:
    """The document as ``json.dumps`` with an indent writes it, each marker replaced by a list's items."""
    rest = json.dumps(document, indent=2, ensure_ascii=False) + "\n"
    for marker, items in lists.items():
        head, rest = rest.split(json.dumps(marker), 1)
        margin = head[head.rindex("\n") + 1 :]
        yield head.rstrip()
        n = -1
        for n, item in enumerate(items):
            yield (",\n" if n else "\n") + textwrap.indent(json.dumps(item, indent=2, ensure_ascii=False), margin)
        rest = rest.lstrip() if n < 0 else rest
    yield rest


def metadata(root: str, statistics: dict, gaps: DataFrame, **scan) -> dict:
    """When and of what an export was made: the scan's ``started_at``, ``duration_ms`` and bounds are the caller's."""
    return {
        "version": VERSION,
        "exported_at": datetime.now(UTC).isoformat(),
        "scan_started_at": scan.get("started_at"),
        "scan_duration_ms": scan.get("duration_ms"),
        "root": root,
        "files_seen": statistics.get("files"),
        "entities_scanned": statistics.get("entities"),
        "groups": statistics.get("groups"),
        "rules_total": statistics.get("rules"),
        "gaps_total": gaps.count(),
        "suppressed": scan.get("suppressed"),
        "min_confidence": scan.get("min_confidence"),
        "min_group_size": scan.get("min_group_size"),
        "rules_referenced": gaps.select("rule_id").distinct().count(),
    }


def json_chunks(gaps: DataFrame, entities: DataFrame, statistics: dict, meta: dict | None = None) -> Iterator[str]:
    """Every gap as JSON, in parts of the document."""
    rows, here = json_rows(gaps, entities), uuid.uuid4().hex
    summary = {"gaps": rows.count(), "rules": statistics.get("rules", 0)}
    found = (r.asDict(recursive=True) for r in rows.orderBy("id").toLocalIterator())
    return _filled(({"meta": meta} if meta else {}) | {"scan": statistics, "summary": summary, "gaps": [here]}, {here: found})


def json_document(gaps: DataFrame, entities: DataFrame, statistics: dict, meta: dict | None = None) -> str:
    return "".join(json_chunks(gaps, entities, statistics, meta))


def csv_chunks(gaps: DataFrame, entities: DataFrame) -> Iterator[str]:
    """Every gap as CSV, the most confident first, a line at a time."""
    line = io.StringIO()
    writer = csv.writer(line)
    rows = csv_rows(gaps, entities).orderBy(F.desc("confidence"), "gap_id")
    for row in itertools.chain([CSV_COLUMNS], rows.toLocalIterator()):
        writer.writerow(row)
        yield line.getvalue()
        line.seek(0)
        line.truncate()


def _described(r) -> dict:
    return {
        "id": r.rule_id,
        "name": f"{r.feature_kind}/{r.feature_value}",
        "shortDescription": {"text": f"`{r.feature_value}` is the rule in `{r.group_id}`."},
        "defaultConfiguration": {"level": r.level},
        "properties": {"support_n": r.support_n, "support_total": r.support_total, "confidence": round(r.confidence, 4)},
    }


def _result(r) -> dict:
    return {
        "ruleId": r.rule_id,
        "ruleIndex": r.rule_index,
        "level": r.level,
        "message": {"text": r.message},
        "locations": [{"physicalLocation": {"artifactLocation": {"uri": r.file_path}, "region": {"startLine": r.line}}}],
        "fingerprints": {f"{TOOL}/v1": r.gap_id},
        "partialFingerprints": {"primary": r.short_id},
    }


def sarif_chunks(gaps: DataFrame, entities: DataFrame, root: str) -> Iterator[str]:
    """Every gap and its rule as SARIF, in parts of the document."""
    rows = sarif_results(gaps, entities)
    rules = rows.dropDuplicates(["rule_id"]).orderBy("rule_index").toLocalIterator()
    results = rows.orderBy("rule_index", "gap_id").toLocalIterator()
    of_rules, of_results = uuid.uuid4().hex, uuid.uuid4().hex
    run = {
        "tool": {"driver": {"name": TOOL, "rules": [of_rules]}},
        "results": [of_results],
        "originalUriBaseIds": {"ROOTPATH": {"uri": Path(root).absolute().as_uri()}},
        "invocations": [{"executionSuccessful": True}],
    }
    lists = {of_rules: (_described(r) for r in rules), of_results: (_result(r) for r in results)}
    return _filled({"version": "2.1.0", "runs": [run]}, lists)


def sarif_document(gaps: DataFrame, entities: DataFrame, root: str) -> str:
    return "".join(sarif_chunks(gaps, entities, root))
