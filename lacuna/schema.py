"""Canonical frames that every operator takes and returns.

entities  entity_id, kind, qualified_name, file_path, line, ordinal
features  entity_id, kind                 the kind's key is present, even with no value
values    entity_id, kind, value          the sets, a row a member
members   selector_ord, selector_type, name, group_id, entity_id
rules     strategy_ord, emit, group_id, feature_kind, feature_value, support_n,
          support_total, confidence, rule_id
gaps      the rule's columns, entity_id, gap_id, short_id

Entities are unique by id; features and values hold each row once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

ENTITY = "entity_id string, kind string, qualified_name string, file_path string, line int, ordinal long"
FEATURE = "entity_id string, kind string"
VALUE = "entity_id string, kind string, value string"
EXTRACTED = f"{ENTITY}, features map<string,array<string>>"

RULE_COLUMNS = [
    "strategy_ord",
    "emit",
    "group_id",
    "feature_kind",
    "feature_value",
    "support_n",
    "support_total",
    "confidence",
    "rule_id",
]
GAP_COLUMNS = [*RULE_COLUMNS, "entity_id", "gap_id", "short_id"]


@dataclass(frozen=True)
class Corpus:
    """What the strategies mine."""

    entities: DataFrame
    features: DataFrame
    values: DataFrame


@dataclass(frozen=True)
class Findings:
    """Rules and the gaps that break them."""

    rules: DataFrame
    gaps: DataFrame
