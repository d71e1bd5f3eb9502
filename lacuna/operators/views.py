"""Exploration queries over findings: filters, sorts, top lists, drill-downs, diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contains(text: str, *columns: Column | str) -> Column:
    """Case-insensitive substring over several columns, joined by blanks."""
    return F.lower(F.concat_ws(" ", *columns)).contains(text.lower())


def filter_gaps(gaps: DataFrame, entities: DataFrame, text: str) -> DataFrame:
    rows = gaps.join(entities.select("entity_id", "file_path", "qualified_name", "line"), "entity_id")
    return rows.filter(contains(text, "short_id", "file_path", "qualified_name", "feature_value"))


def filter_rules(rules: DataFrame, text: str) -> DataFrame:
    return rules.filter(contains(text, "rule_id", "group_id", "feature_value", F.format_string("%.2f", F.bround("confidence", 2))))


def filter_groups(groups: DataFrame, text: str) -> DataFrame:
    return groups.filter(contains(text, "group_id", "selector_type"))


def filter_suppressions(rows: DataFrame, text: str) -> DataFrame:
    return rows.filter(contains(text, "label", "target", "reason", "source"))


GAP_SORTS = {
    "conf_desc": [F.desc, "confidence"],
    "conf_asc": [F.asc, "confidence"],
    "file": [F.asc, "file_path", "line"],
    "entity": [F.asc, "qualified_name"],
}
RULE_SORTS = {"conf_desc": [F.desc, "confidence"], "support_desc": [F.desc, "support_n"], "group": [F.asc, "group_id"]}
GROUP_SORTS = {"members_desc": [F.desc, "n_members"], "members_asc": [F.asc, "n_members"], "name": [F.asc, "group_id"]}


def _sorted(rows: DataFrame, how: list, tie: str) -> DataFrame:
    way, *columns = how
    return rows.orderBy(*[way(c) for c in columns], tie)


def sort_gaps(gaps: DataFrame, how: str = "conf_desc") -> DataFrame:
    return _sorted(gaps, GAP_SORTS[how], "gap_id")


def sort_rules(rules: DataFrame, how: str = "conf_desc") -> DataFrame:
    return _sorted(rules, RULE_SORTS[how], "rule_id")


def sort_groups(groups: DataFrame, how: str = "members_desc") -> DataFrame:
    return _sorted(groups, GROUP_SORTS[how], "group_id")


def kind_histogram(entities: DataFrame) -> DataFrame:
    return entities.groupBy("kind").agg(F.count("*").alias("n"))


def per_group(groups: DataFrame, rules: DataFrame, gaps: DataFrame) -> DataFrame:
    """Rules and gaps of every group, zero included."""
    r = rules.groupBy("group_id").agg(F.count("*").alias("n_rules"))
    g = gaps.groupBy("group_id").agg(F.count("*").alias("n_gaps"))
    found = groups.select("group_id", "selector_ord", "name", "n_members").join(r, "group_id", "left").join(g, "group_id", "left")
    return found.withColumn("n_rules", F.coalesce("n_rules", F.lit(0))).withColumn("n_gaps", F.coalesce("n_gaps", F.lit(0)))


def top_groups(groups: DataFrame, rules: DataFrame, gaps: DataFrame, n: int = 5) -> DataFrame:
    """Groups with most rules; ties in group order."""
    return per_group(groups, rules, gaps).orderBy(F.desc("n_rules"), "selector_ord", "name").limit(n)


def drill(gaps: DataFrame, members: DataFrame, short_id: str) -> DataFrame:
    """A gap with its rule's group and the group's first member."""
    one = gaps.filter(F.col("short_id") == short_id)
    first = members.join(one.select("group_id"), "group_id", "left_semi").groupBy("group_id").agg(F.min("entity_id").alias("first_member"))
    return one.join(first, "group_id", "left")


def rule_detail(members: DataFrame, features: DataFrame, values: DataFrame, rules: DataFrame) -> DataFrame:
    """Every eligible member of each rule's group: does it exhibit the value?"""
    able = rules.select("rule_id", "group_id", "feature_kind", "feature_value").join(members.select("group_id", "entity_id"), "group_id")
    able = able.join(features.select("entity_id", F.col("kind").alias("feature_kind")), ["entity_id", "feature_kind"], "left_semi")
    have = values.select("entity_id", F.col("kind").alias("feature_kind"), F.col("value").alias("feature_value"), F.lit(True).alias("exhibits"))
    found = able.join(have.distinct(), ["entity_id", "feature_kind", "feature_value"], "left")
    return found.select("rule_id", "entity_id", F.coalesce("exhibits", F.lit(False)).alias("exhibits"))


def group_detail(members: DataFrame, entities: DataFrame, group_id: str) -> DataFrame:
    return members.filter(F.col("group_id") == group_id).select("entity_id").join(entities, "entity_id").orderBy("file_path", "line", "entity_id")


def suppressions_view(local: DataFrame, project: DataFrame) -> DataFrame:
    mine = local.select(F.col("short_id").alias("label"), F.col("full_id").alias("target"), "reason", F.lit("local").alias("source"))
    target = F.concat_ws(" ", F.col("entity"), F.col("rule"))
    theirs = project.select(F.coalesce("scope", F.lit("gap")).alias("label"), target.alias("target"), "reason", F.lit("project").alias("source"))
    return mine.unionByName(theirs)


def scan_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Ids that only one of two scans has."""
    old, new = before.select(key).distinct(), after.select(key).distinct()
    added = new.join(old, key, "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(old.join(new, key, "left_anti").withColumn("change", F.lit("removed")))
