"""Frequency mining: what most members of a group have becomes a rule, the others its gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..schema import GAP_COLUMNS, RULE_COLUMNS, Findings

#: The mined kinds in strategy order.
MINED_KINDS = [
    "decorator",
    "calls",
    "parent_class",
    "sibling_test",
    "has_docstring",
    "has_return_type",
    "has_param_types",
    "has_post_init",
    "has_all_export",
    "call_kwargs",
    "entry_point_registered",
]


def strategy_order(kinds: list[str]):
    return F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind")) - 1


def value_counts(values: DataFrame) -> DataFrame:
    """How many entities have each value, corpus-wide."""
    return values.groupBy("kind", "value").agg(F.count("*").alias("n"))


def prune_threshold(min_confidence: float) -> int:
    return max(1, int(min_confidence * 2))


def pruned(values: DataFrame, min_confidence: float) -> DataFrame:
    """Drop values too rare to matter; nothing is, unless the threshold is above one."""
    least = prune_threshold(min_confidence)
    if least <= 1:
        return values
    return values.join(value_counts(values).filter(F.col("n") >= least), ["kind", "value"], "left_semi")


def profiles(features: DataFrame, values: DataFrame) -> DataFrame:
    """One row an entity: ``kinds``, an array of its kinds with their sets, empty ones included.

    Keys and values meet in a single shuffle by entity, and stay partitioned that way
    for the join with the members.
    """
    rows = features.select("entity_id", "kind", F.lit(None).cast("string").alias("value"))
    pairs = rows.unionByName(values.select("entity_id", "kind", "value"))
    packed = pairs.groupBy("entity_id").agg(F.collect_set(F.struct("kind", "value")).alias("pairs"))
    sets = F.expr(
        """transform(filter(pairs, p -> p.value IS NULL),
                     k -> struct(k.kind AS kind, transform(filter(pairs, p -> p.kind = k.kind AND p.value IS NOT NULL), p -> p.value) AS vs))"""
    )
    return packed.select("entity_id", sets.alias("kinds"))


def eligible(members: DataFrame, features: DataFrame) -> DataFrame:
    """Group members with each kind whose key they have."""
    return members.join(features, "entity_id")


def group_counts(members: DataFrame, features: DataFrame, values: DataFrame) -> DataFrame:
    """Members of each group with each value, and with the kind's key at all (``support_total``).

    Keys count as a null value, so one join and one aggregation give both numbers; the
    window runs over the counts.
    """
    rows = features.select("entity_id", "kind", F.lit(None).cast("string").alias("value"))
    rows = rows.unionByName(values.select("entity_id", "kind", "value"))
    found = members.select("selector_ord", "selector_type", "name", "group_id", "entity_id").join(rows, "entity_id")
    counts = found.groupBy("selector_ord", "selector_type", "name", "group_id", "kind", "value").agg(F.count("*").alias("support_n"))
    of_kind = Window.partitionBy("group_id", "kind")
    total = F.max(F.when(F.col("value").isNull(), F.col("support_n"))).over(of_kind)
    return counts.withColumn("support_total", total).filter("value is not null and support_total is not null")


def mine(
    members: DataFrame,
    features: DataFrame,
    values: DataFrame,
    *,
    min_confidence: float = 0.8,
    kinds: list[str] | None = None,
) -> Findings:
    """All kinds in one pass, with the kind as a grouping column."""
    kinds = kinds or MINED_KINDS
    features = features.filter(F.col("kind").isin(*kinds))
    values = pruned(values.filter(F.col("kind").isin(*kinds)), min_confidence)
    confidence = F.col("support_n").cast("double") / F.col("support_total")
    # a group's own identity is no finding
    identity = (F.col("selector_type") == F.col("kind")) & (F.col("name") == F.col("value"))
    rules = group_counts(members, features, values).withColumn("confidence", confidence)
    rules = rules.filter((F.col("confidence") >= min_confidence) & ~identity)
    rules = rules.select(
        strategy_order(kinds).cast("int").alias("strategy_ord"),
        F.struct(F.col("selector_ord").cast("string").alias("a"), F.col("name").alias("b"), F.col("value").alias("c")).alias("emit"),
        "group_id",
        F.col("kind").alias("feature_kind"),
        F.col("value").alias("feature_value"),
        "support_n",
        "support_total",
        "confidence",
        names.rule_id("group_id", "kind", "value").alias("rule_id"),
    )
    broken = rules.filter("support_n < support_total")  # a unanimous rule has no gap to look for
    sets = members.select("group_id", "entity_id").join(profiles(features, values), "entity_id")
    sets = sets.select("group_id", "entity_id", F.inline("kinds")).withColumnRenamed("kind", "feature_kind")
    # whoever lacks the value is known from the set at hand: no anti-join with all values
    gaps = broken.join(sets, ["group_id", "feature_kind"]).filter(~F.array_contains("vs", F.col("feature_value")))
    itself = (F.col("feature_kind") == "parent_class") & (names.last_segment("entity_id") == F.col("feature_value"))
    gaps = with_gap_ids(gaps.filter(~itself))
    return Findings(rules.select(*RULE_COLUMNS), gaps)


def with_gap_ids(gaps: DataFrame) -> DataFrame:
    full = names.gap_id("rule_id", "entity_id")
    return gaps.withColumn("gap_id", full).withColumn("short_id", names.short_id(full)).select(*GAP_COLUMNS)
