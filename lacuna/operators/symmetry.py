"""Pairs: methods that come together in a scope, and calls that come together in a function."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..schema import RULE_COLUMNS, Findings
from .frequency import with_gap_ids

#: Pairs known beforehand; left calls for right.
BUILTIN_PAIRS = [
    ("context_manager", "__enter__", "__exit__", "class", "a context manager that can't be left"),
    ("async_context_manager", "__aenter__", "__aexit__", "class", "an async context manager that can't be left"),
]
PAIR = "name string, left string, right string, scope string, description string"
SYMMETRY_ORD, CALL_PAIR_ORD = 11, 12


def builtin_pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BUILTIN_PAIRS, PAIR)


def scope_index(entities: DataFrame) -> DataFrame:
    """``scope, scope_id, name, entity_id``: the first entity of each name in each scope."""
    name = names.short_name("qualified_name").alias("name")
    place = F.struct("file_path", "ordinal", "entity_id").alias("place")
    in_class = entities.filter(F.col("kind") == "method").select(
        F.lit("class").alias("scope"), names.class_scope("kind", "qualified_name").alias("scope_id"), name, place
    )
    in_file = entities.filter(F.col("kind").isin("function", "method")).select(
        F.lit("file").alias("scope"), F.col("file_path").alias("scope_id"), name, place
    )
    rows = in_class.filter("scope_id is not null").unionByName(in_file)
    first = rows.groupBy("scope", "scope_id", "name").agg(F.min("place").alias("place"))
    return first.select("scope", "scope_id", "name", F.col("place.entity_id").alias("entity_id"))


def name_counts(index: DataFrame) -> DataFrame:
    return index.groupBy("scope", "name").agg(F.count("*").alias("n"))


def _reaches(one: str, other: str, min_support: int, min_confidence: float):
    """Whether names this frequent can hold one way: together they come as often as the rarer at most."""
    more = (F.col(one) >= min_support) & (F.col(other) >= min_confidence * F.col(one) - 1e-9)
    return more | ((F.col(other) >= min_support) & (F.col(one) >= min_confidence * F.col(other) - 1e-9))


def qualifying_pairs(index: DataFrame, min_support: int, min_confidence: float = 0.0) -> DataFrame:
    """Unordered name pairs that share a scope; one name at least is frequent.

    With a confidence only pairs whose names are frequent enough to reach it.
    """
    counted = index.join(name_counts(index), ["scope", "name"])
    # a name that is too rare even beside the least frequent name that counts meets no other
    counted = counted.filter(F.col("n") >= min_confidence * min_support - 1e-9)
    left = counted.filter(F.col("n") >= min_support).select("scope", "scope_id", F.col("name").alias("a"), F.col("n").alias("n_a"))
    right = counted.select("scope", "scope_id", F.col("name").alias("b"), F.col("n").alias("n_b"))
    # only frequent names meet others: the join never pairs two rare names
    met = (F.col("a") != F.col("b")) & ((F.col("n_b") < min_support) | (F.col("a") < F.col("b")))
    met = left.join(right, ["scope", "scope_id"]).filter(met & _reaches("n_a", "n_b", min_support, min_confidence))
    return met.groupBy("scope", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("n_both"))


def directional(pairs: DataFrame, counts: DataFrame, min_support: int, min_confidence: float) -> DataFrame:
    """``scope, left, right, n_left, n_both``: pairs that hold one way, with a violator at least."""
    ways = pairs.select("scope", F.col("a").alias("left"), F.col("b").alias("right"), "n_both").unionByName(
        pairs.select("scope", F.col("b").alias("left"), F.col("a").alias("right"), "n_both")
    )
    found = ways.join(counts.select("scope", F.col("name").alias("left"), F.col("n").alias("n_left")), ["scope", "left"])
    confidence = F.col("n_both").cast("double") / F.col("n_left")
    return found.filter((F.col("n_left") >= min_support) & (confidence >= min_confidence) & (F.col("n_both") < F.col("n_left")))


def mine_pairs(entities: DataFrame, min_support: int = 3, min_confidence: float = 0.8) -> DataFrame:
    """Mined symmetry pairs of class and file scopes."""
    index = scope_index(entities)
    found = directional(qualifying_pairs(index, min_support, min_confidence), name_counts(index), min_support, min_confidence)
    name = F.concat(F.lit("mined:"), F.col("left"), F.lit("_to_"), F.col("right"))
    return found.select(name.alias("name"), "left", "right", "scope", F.lit("mined").alias("description"))


def symmetry_gaps(
    entities: DataFrame,
    pairs: DataFrame | None = None,
    *,
    auto_mine: bool = True,
    min_support: int = 3,
    min_confidence: float = 0.8,
) -> Findings:
    """Scopes with the left name and without the right one; ``pairs`` replaces known and mined pairs."""
    index = scope_index(entities)
    if pairs is None:
        pairs = builtin_pairs(entities.sparkSession).withColumn("pair_ord", F.lit(0))
        if auto_mine:
            mined = mine_pairs(entities, min_support, min_confidence)
            pairs = pairs.unionByName(mined.withColumn("pair_ord", F.when(F.col("scope") == "class", 1).otherwise(2)))
    else:
        pairs = pairs.withColumn("pair_ord", F.lit(0))
    lefts = index.withColumnRenamed("name", "left").join(pairs, ["scope", "left"])
    rights = index.select("scope", "scope_id", F.col("name").alias("right"), F.lit(True).alias("held"))
    checked = lefts.join(rights, ["scope", "scope_id", "right"], "left").withColumn("held", F.coalesce("held", F.lit(False)))
    key = ["pair_ord", "name", "left", "right", "scope"]
    support = checked.groupBy(*key).agg(F.sum(F.col("held").cast("long")).alias("support_n"), F.count("*").alias("support_total"))
    group = F.concat(F.lit("symmetry:"), F.col("name"))
    rules = support.select(
        F.lit(SYMMETRY_ORD).alias("strategy_ord"),
        F.struct(F.col("pair_ord").cast("string").alias("a"), F.col("left").alias("b"), F.col("right").alias("c")).alias("emit"),
        group.alias("group_id"),
        F.lit("symmetry").alias("feature_kind"),
        F.col("right").alias("feature_value"),
        "support_n",
        "support_total",
        (F.col("support_n").cast("double") / F.col("support_total")).alias("confidence"),
        names.rule_id(group, F.lit("symmetry"), "right").alias("rule_id"),
        *key,
    )
    missing = checked.filter("not held").select(*key, "entity_id")
    gaps = missing.join(rules, key)
    return Findings(rules.select(*RULE_COLUMNS), with_gap_ids(gaps))


def callers(entities: DataFrame, values: DataFrame) -> DataFrame:
    """``caller, call`` of functions and methods that call anything."""
    able = entities.filter(F.col("kind").isin("function", "method")).select("entity_id")
    calls = values.filter(F.col("kind") == "calls").join(able, "entity_id", "left_semi")
    return calls.select(F.col("entity_id").alias("caller"), F.col("value").alias("call")).distinct()


def call_pairs(calls: DataFrame, min_support: int = 5, min_confidence: float = 0.9) -> DataFrame:
    """``left, right, n_left, n_both``: both calls are popular, and the pair holds one way."""
    counts = calls.groupBy("call").agg(F.count("*").alias("n")).filter(F.col("n") >= min_support)
    popular = calls.join(counts, "call")
    left = popular.select("caller", F.col("call").alias("a"), F.col("n").alias("n_a"))
    right = popular.select("caller", F.col("call").alias("b"), F.col("n").alias("n_b"))
    both = left.join(right, "caller").filter((F.col("a") < F.col("b")) & _reaches("n_a", "n_b", min_support, min_confidence))
    both = both.groupBy("a", "b").agg(F.count("*").alias("n_both")).withColumn("scope", F.lit("caller"))
    counts = counts.select(F.lit("caller").alias("scope"), F.col("call").alias("name"), "n")
    return directional(both, counts, min_support, min_confidence)


def call_pair_gaps(entities: DataFrame, values: DataFrame, *, min_support: int = 5, min_confidence: float = 0.9) -> Findings:
    """Functions with one call of a pair and not the other."""
    calls = callers(entities, values)
    found = call_pairs(calls, min_support, min_confidence)
    group = F.concat(F.lit("call_pair:"), F.col("left"))
    rules = found.select(
        F.lit(CALL_PAIR_ORD).alias("strategy_ord"),
        F.struct(F.lit("0").alias("a"), F.col("left").alias("b"), F.col("right").alias("c")).alias("emit"),
        group.alias("group_id"),
        F.lit("call_pair").alias("feature_kind"),
        F.col("right").alias("feature_value"),
        F.col("n_both").alias("support_n"),
        F.col("n_left").alias("support_total"),
        (F.col("n_both").cast("double") / F.col("n_left")).alias("confidence"),
        names.rule_id(group, F.lit("call_pair"), "right").alias("rule_id"),
        "left",
    )
    with_left = rules.join(calls.select(F.col("call").alias("left"), F.col("caller").alias("entity_id")), "left")
    have = calls.select(F.col("caller").alias("entity_id"), F.col("call").alias("feature_value"))
    gaps = with_left.join(have, ["entity_id", "feature_value"], "left_anti")
    return Findings(rules.select(*RULE_COLUMNS), with_gap_ids(gaps))
