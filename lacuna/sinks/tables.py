"""Findings as tables: rows for CSV, JSON and SARIF."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names

CSV_COLUMNS = [
    "gap_id", "short_id", "file_path", "line", "entity_kind", "entity_qualified_name", "rule_id",
    "feature_kind", "feature_value", "confidence", "support_n", "support_total", "group_id",
]


def located(gaps: DataFrame, entities: DataFrame) -> DataFrame:
    """Gaps with where their entity stands."""
    where = entities.select("entity_id", "file_path", "line", F.col("kind").alias("entity_kind"), "qualified_name")
    return gaps.join(where, "entity_id")


def csv_rows(gaps: DataFrame, entities: DataFrame) -> DataFrame:
    rows = located(gaps, entities).withColumn("entity_qualified_name", F.col("qualified_name"))
    return rows.withColumn("confidence", F.format_string("%.4f", F.bround("confidence", 4))).select(*CSV_COLUMNS)


def write_csv(gaps: DataFrame, entities: DataFrame, path: str) -> None:
    csv_rows(gaps, entities).write.option("header", True).csv(path)


def json_rows(gaps: DataFrame, entities: DataFrame) -> DataFrame:
    """One self-contained record a gap, its rule and entity inlined."""
    rule = F.struct(
        F.col("rule_id").alias("id"), "group_id", "feature_kind", "feature_value", "support_n", "support_total",
        F.bround("confidence", 4).alias("confidence"),
    )
    entity = F.struct(F.col("entity_id").alias("id"), F.col("entity_kind").alias("kind"), "qualified_name", "file_path", "line")
    return located(gaps, entities).select(F.col("gap_id").alias("id"), "short_id", rule.alias("rule"), entity.alias("entity"))


def write_json(gaps: DataFrame, entities: DataFrame, path: str) -> None:
    json_rows(gaps, entities).write.json(path)


def sarif_results(gaps: DataFrame, entities: DataFrame) -> DataFrame:
    """One SARIF result a gap; rules are numbered in the order of their ids."""
    # the window sees each rule once, not each gap
    number = gaps.select("rule_id").distinct()
    number = number.withColumn("rule_index", (F.row_number().over(Window.orderBy("rule_id")) - 1).cast("long"))
    rows = located(gaps, entities).join(number, "rule_id")
    text = F.format_string(
        "`%s` lacks `%s` (%s), as %d of %d in `%s` do not (confidence %.2f).",
        "qualified_name", "feature_value", "feature_kind", "support_n", "support_total", "group_id", "confidence",
    )
    return rows.withColumn("level", names.sarif_level("confidence")).withColumn("message", text)
