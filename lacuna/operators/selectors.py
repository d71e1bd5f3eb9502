"""Groups of entities: by directory, decorator or parent class."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names

DIRECTORY_KINDS = ("function", "class", "module")
PARENT_KINDS = ("class", "struct", "enum", "extension", "protocol", "interface", "trait", "impl", "module", "record")
DECORATOR_EXCLUDES = ("@property", "@staticmethod", "@classmethod")
PARENT_EXCLUDES = ("object",)
_ORDER = {"directory": 0, "decorator": 1, "parent_class": 2}


def _members(rows: DataFrame, selector: str, min_members: int) -> DataFrame:
    """Keep the groups (column ``name``) that have enough members; a member occurs once a group."""
    rows = rows.select("name", "entity_id")
    # counts combine map-side, so a group that holds much of the corpus costs one row a task
    large = rows.groupBy("name").agg(F.count("*").alias("n_members")).filter(F.col("n_members") >= min_members)
    kept = rows.join(large, "name")
    return kept.select(
        F.lit(_ORDER[selector]).alias("selector_ord"),
        F.lit(selector).alias("selector_type"),
        "name",
        F.concat(F.lit(f"{selector}::"), F.col("name")).alias("group_id"),
        "entity_id",
        "n_members",
    )


def directory_groups(entities: DataFrame, min_members: int = 3, kinds: tuple[str, ...] = DIRECTORY_KINDS) -> DataFrame:
    rows = entities.filter(F.col("kind").isin(*kinds)) if kinds else entities
    return _members(rows.select(names.parent_directory("file_path").alias("name"), "entity_id"), "directory", min_members)


def decorator_groups(values: DataFrame, min_members: int = 3, exclude: tuple[str, ...] = DECORATOR_EXCLUDES) -> DataFrame:
    rows = values.filter((F.col("kind") == "decorator") & ~F.col("value").isin(*exclude))
    return _members(rows.select(F.col("value").alias("name"), "entity_id"), "decorator", min_members)


def parent_class_groups(
    entities: DataFrame,
    values: DataFrame,
    min_members: int = 3,
    exclude: tuple[str, ...] = PARENT_EXCLUDES,
    kinds: tuple[str, ...] = PARENT_KINDS,
) -> DataFrame:
    rows = values.filter((F.col("kind") == "parent_class") & ~F.col("value").isin(*exclude))
    of_kind = entities.filter(F.col("kind").isin(*kinds)).select("entity_id")
    rows = rows.join(of_kind, "entity_id", "left_semi")
    return _members(rows.select(F.col("value").alias("name"), "entity_id"), "parent_class", min_members)


def union_groups(*selected: DataFrame | None) -> DataFrame:
    """The groups of all enabled selectors, in order; None is a disabled one."""
    return reduce(DataFrame.unionByName, [s for s in selected if s is not None])


def groups(members: DataFrame) -> DataFrame:
    """A row for each group."""
    return members.select("selector_ord", "selector_type", "name", "group_id", "n_members").distinct()
