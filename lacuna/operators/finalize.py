"""From all strategies' findings to the list to report: dedup, suppression, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Findings


def union_findings(found: list[Findings]) -> Findings:
    return Findings(
        reduce(DataFrame.unionByName, [f.rules for f in found]),
        reduce(DataFrame.unionByName, [f.gaps for f in found]),
    )


def rules_by_id(rules: DataFrame) -> DataFrame:
    """One rule an id; the last emitted wins."""
    order = F.struct("strategy_ord", "emit")
    return rules.groupBy("rule_id").agg(F.max_by(F.struct(*[c for c in rules.columns if c != "rule_id"]), order).alias("r")).select("rule_id", "r.*")


def dedup_gaps(gaps: DataFrame) -> DataFrame:
    """One gap for each entity and value: highest confidence, then earliest strategy and emission."""
    order = F.struct(-F.col("confidence"), "strategy_ord", "emit", "rule_id")
    rest = [c for c in gaps.columns if c not in ("entity_id", "feature_value")]
    # min_by combines map-side; a window would ship every gap of a hot value
    best = gaps.groupBy("entity_id", "feature_value").agg(F.min_by(F.struct(*rest), order).alias("g"))
    return best.select("entity_id", "feature_value", "g.*").select(*gaps.columns)


def ranked(gaps: DataFrame) -> DataFrame:
    return gaps.orderBy(F.desc("confidence"), "strategy_ord", "emit", "entity_id")


def suppress_local(gaps: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Drop gaps whose short or full id is listed: two equi-joins instead of an OR."""
    short = suppressions.select("short_id").filter("short_id is not null").distinct()
    full = suppressions.select(F.col("full_id").alias("gap_id")).filter("gap_id is not null").distinct()
    return gaps.join(short, "short_id", "left_anti").join(full, "gap_id", "left_anti").select(*gaps.columns)


def suppress_project(gaps: DataFrame, entries: DataFrame) -> DataFrame:
    """Drop gaps that reviewed entries cover.

    ``rule_global`` needs a rule, matched by id or value; ``gap`` (the default)
    needs the entity, and the rule if given; other scopes match nothing.
    """
    scope = F.lower(F.coalesce(F.when(F.col("scope") != "", F.col("scope")), F.lit("gap")))
    has = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    marked = entries.select(scope.alias("s"), F.col("rule").alias("r"), F.col("entity").alias("e"), has("rule").alias("has_rule"), has("entity").alias("has_entity"))
    everywhere = marked.filter("s = 'rule_global' and has_rule").select("r").distinct()
    one = marked.filter("s = 'gap' and has_entity")
    whole = one.filter("not has_rule").select(F.col("e").alias("entity_id")).distinct()
    exact = one.filter("has_rule").select(F.col("e").alias("entity_id"), "r").distinct()
    left = gaps.join(everywhere.withColumnRenamed("r", "rule_id"), "rule_id", "left_anti")
    left = left.join(everywhere.withColumnRenamed("r", "feature_value"), "feature_value", "left_anti")
    left = left.join(whole, "entity_id", "left_anti")
    left = left.join(exact.withColumnRenamed("r", "rule_id"), ["entity_id", "rule_id"], "left_anti")
    left = left.join(exact.withColumnRenamed("r", "feature_value"), ["entity_id", "feature_value"], "left_anti")
    return left.select(*gaps.columns)


def scan_statistics(entities: DataFrame, groups: DataFrame, rules: DataFrame, gaps: DataFrame) -> DataFrame:
    """One row: how much was scanned and found."""
    one = entities.agg(F.count("*").alias("entities"), F.countDistinct("file_path").alias("files"))
    one = one.crossJoin(groups.agg(F.count("*").alias("groups")))  # single rows
    one = one.crossJoin(rules.agg(F.count("*").alias("rules")))
    return one.crossJoin(gaps.agg(F.count("*").alias("gaps"), F.countDistinct("rule_id").alias("rules_with_gaps")))


def exit_code(n_gaps: int, max_gaps: int | None = None, error: bool = False) -> int:
    """0: clean; 1: gaps, or more than allowed; 2: the scan failed."""
    if error:
        return 2
    return int(n_gaps > (max_gaps or 0))
