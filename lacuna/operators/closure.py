"""Closure: classes that nothing refers to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..schema import RULE_COLUMNS, Findings
from .frequency import with_gap_ids

CLOSURE_ORD = 17
REFERENCE_KINDS = ("calls", "parent_class", "decorator")


def referenced_names(values: DataFrame) -> DataFrame:
    """Every name that a call, parent class or decorator mentions, whole and by its last part."""
    refs = values.filter(F.col("kind").isin(*REFERENCE_KINDS)).select("value").distinct()
    return refs.select(F.explode(names.reference_names("value")).alias("name")).distinct()


def class_candidates(entities: DataFrame, features: DataFrame, values: DataFrame) -> DataFrame:
    """Public classes outside tests that no entry point registers."""
    registered = values.filter("kind = 'entry_point_registered'").select("entity_id").distinct()
    name = names.bare_class_name("qualified_name")
    rows = entities.filter("kind = 'class'").withColumn("name", name)
    rows = rows.filter((F.col("name") != "") & ~F.col("name").startswith("_") & ~names.is_test_file("file_path"))
    return rows.join(registered, "entity_id", "left_anti").select("entity_id", "name", "file_path")


def unreferenced(entities: DataFrame, features: DataFrame, values: DataFrame) -> DataFrame:
    return class_candidates(entities, features, values).join(referenced_names(values), "name", "left_anti")


def token_counts(texts: DataFrame, wanted: DataFrame, text_col: str = "text") -> DataFrame:
    """How often each wanted ``name`` stands as an identifier in the texts."""
    tokens = texts.select(F.explode(names.identifiers(text_col)).alias("name"))
    # partial counts first: a frequent word crosses the network once a task
    return tokens.join(wanted.select("name").distinct(), "name", "left_semi").groupBy("name").agg(F.count("*").alias("n"))


def unused_class_gaps(entities: DataFrame, features: DataFrame, values: DataFrame, texts: DataFrame | None = None) -> Findings:
    """Unreferenced classes; with texts, only those whose name stands there once at most."""
    found = unreferenced(entities, features, values)
    if texts is not None:
        counts = token_counts(texts, found)
        found = found.join(counts, "name", "left").filter(F.coalesce("n", F.lit(0)) <= 1).drop("n")
    group = F.concat(F.lit("closure:"), F.col("file_path"))
    value = F.concat(F.col("name"), F.lit(" (defined but never used)"))
    rules = found.select(
        F.lit(CLOSURE_ORD).alias("strategy_ord"),
        F.struct(F.lit("0").alias("a"), F.col("file_path").alias("b"), F.col("entity_id").alias("c")).alias("emit"),
        group.alias("group_id"),
        F.lit("closure").alias("feature_kind"),
        value.alias("feature_value"),
        F.lit(1).cast("long").alias("support_n"),
        F.lit(1).cast("long").alias("support_total"),
        F.lit(1.0).alias("confidence"),
        names.rule_id(group, F.lit("closure"), value).alias("rule_id"),
        "entity_id",
    )
    return Findings(rules.select(*RULE_COLUMNS), with_gap_ids(rules))
