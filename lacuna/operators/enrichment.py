"""Features that need the whole corpus: sibling tests and registered entry points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..schema import Corpus

ABSTRACT_PARENTS = ["ABC", "abc.ABC"]


def test_index(entities: DataFrame) -> DataFrame:
    """``test_file, name``: the test functions of every test file."""
    rows = entities.filter(F.col("kind").isin("function", "method") & names.is_test_file("file_path"))
    rows = rows.select(F.col("file_path").alias("test_file"), names.short_name("qualified_name").alias("name"))
    return rows.filter(F.col("name").startswith("test_")).distinct()


def candidate_test_ids(entities: DataFrame) -> DataFrame:
    """``entity_id, candidate``: ids that a free test function of an entity could have."""
    short = names.last_segment("qualified_name")
    rows = entities.select("entity_id", short.alias("short"), F.explode(names.candidate_test_files("file_path")).alias("f"))
    return rows.select("entity_id", F.concat("f", F.lit("::test_"), "short").alias("candidate"))


def sibling_tests(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feature and value rows: who should have a sibling test, and who has one."""
    target = names.last_segment("qualified_name")
    able = entities.filter(F.col("kind").isin("function", "method") & ~names.is_test_file("file_path") & ~target.startswith("_"))
    features = able.select("entity_id", F.lit("sibling_test").alias("kind"))
    # candidates once a file, not once an entity
    files = able.select("file_path").distinct()
    files = files.select("file_path", F.explode(names.candidate_test_files("file_path")).alias("test_file"))
    tested = files.join(test_index(entities), "test_file").select("file_path", "name").distinct()
    asked = able.select("entity_id", "file_path", F.concat(F.lit("test_"), target).alias("name"))
    found = asked.join(tested, ["file_path", "name"], "left_semi")
    return features, found.select("entity_id", F.lit("sibling_test").alias("kind"), F.lit("sibling test").alias("value"))


def entry_points(entities: DataFrame, values: DataFrame, registered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes beside a registered class are expected to be registered; ``registered``: ``suffix, class``."""
    classes = entities.filter("kind = 'class'").select("entity_id", "qualified_name", "file_path")
    # declarations of one project file; the class name makes it an equi-join
    named = classes.withColumn("class", names.last_segment("qualified_name"))
    hit = named.join(registered, "class").filter(F.endswith("file_path", "suffix")).select("entity_id", "file_path").distinct()
    places = hit.select(names.directory("file_path").alias("dir")).distinct()
    abstract = values.filter((F.col("kind") == "parent_class") & F.col("value").isin(*ABSTRACT_PARENTS)).select("entity_id")
    near = classes.withColumn("dir", names.directory("file_path")).join(places, "dir", "left_semi").join(abstract, "entity_id", "left_anti")
    features = near.select("entity_id", F.lit("entry_point_registered").alias("kind"))
    found = near.join(hit.select("entity_id"), "entity_id", "left_semi")
    return features, found.select("entity_id", F.lit("entry_point_registered").alias("kind"), F.lit("registered").alias("value"))


def enrich(corpus: Corpus, registered: DataFrame | None = None) -> Corpus:
    features, values = sibling_tests(corpus.entities)
    features, values = corpus.features.unionByName(features), corpus.values.unionByName(values)
    if registered is not None:
        more, held = entry_points(corpus.entities, corpus.values, registered)
        features, values = features.unionByName(more), values.unionByName(held)
    return Corpus(corpus.entities, features, values)
