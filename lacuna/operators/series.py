"""Series: holes in numbered, lettered and versioned names, and in named alphabets.

The three positional detectors share one gaps-and-islands core over rows
``key, n, width, path`` and differ in how names are parsed and rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names
from ..schema import RULE_COLUMNS, Findings
from .frequency import with_gap_ids

SERIES_ORD, LETTER_ORD, VERSION_ORD, ORDINAL_ORD = 13, 14, 15, 16
MIN_MEMBERS, MAX_GAP = 3, 5
#: Numbers of a key that one task orders.
SPAN = 4096

#: Alphabets of ordered slots, each a list of synonyms, and the
#: class-name hints that admit them (none: always).
ALPHABETS = [
    (
        "crud",
        [
            ["create", "add", "insert"],
            ["read", "get", "list", "find", "findAll", "findOne", "fetch", "show"],
            ["update", "edit", "modify", "patch"],
            ["delete", "remove", "destroy"],
        ],
        ["crud", "repo", "repository", "controller", "service", "resolver", "dao", "store", "manager"],
    ),
    (
        "lifecycle_three",
        [
            ["init", "initialize", "setup", "start"],
            ["run", "execute", "process"],
            ["close", "teardown", "stop", "shutdown", "cleanup"],
        ],
        ["job", "task", "worker", "runner", "pipeline", "step"],
    ),
    ("ordinal_three", [["first"], ["second"], ["third"]], []),
]
ALPHABET = "alphabet string, slots array<array<string>>, hints array<string>"


def _placed(rows: DataFrame, key: list[str], max_gap: int) -> DataFrame:
    """Rows with the next number in their bucket and the run that they are in.

    A bucket is ``SPAN`` numbers of a key, so no task orders a whole directory.
    """
    order = Window.partitionBy(*key, "bucket").orderBy("n", "width", "path")
    rows = rows.withColumn("bucket", F.expr(f"n div {SPAN}L")).withColumn("next_n", F.lead("n").over(order))
    jump = F.when(F.col("n") - F.lag("n").over(order) > max_gap, 1).otherwise(0)
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("jump", jump).withColumn("run", F.sum("jump").over(running)).drop("jump")


def _runs(placed: DataFrame, key: list[str], max_gap: int) -> DataFrame:
    """One row a run with its island: runs of neighbouring buckets join where they are close.

    ``edges`` are the members that a hole may follow; the last one's next number is null.
    """
    step = F.col("next_n") - F.col("n")
    last = step.isNull() | (step > max_gap)
    edge = F.struct("n", F.when(~last, F.col("next_n")).alias("next_n"), "path", "ext")
    mark = F.xxhash64("ext")
    runs = placed.groupBy(*key, "bucket", "run").agg(
        F.count("*").alias("held"),
        F.min("n").alias("lo"),
        F.max("n").alias("hi"),
        F.max("width").alias("width"),
        F.min(mark).alias("ext_lo"),
        F.max(mark).alias("ext_hi"),
        F.collect_list(F.when(last | (step > 1), edge)).alias("edges"),
    )
    along = Window.partitionBy(*key).orderBy("lo")
    runs = runs.withColumn("next_lo", F.lead("lo").over(along))
    jump = F.when(F.col("lo") - F.lag("hi").over(along) > max_gap, 1).otherwise(0)
    running = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return runs.withColumn("jump", jump).withColumn("island", F.sum("jump").over(running)).drop("jump")


def clusters(rows: DataFrame, key: list[str], max_gap: int = MAX_GAP, min_members: int = MIN_MEMBERS) -> DataFrame:
    """Number the islands of each key: a new one wherever the step exceeds ``max_gap``."""
    placed = _placed(rows, key, max_gap)
    runs = _runs(placed, key, max_gap).withColumn("in_key", F.sum("held").over(Window.partitionBy(*key)))
    runs = runs.filter(F.col("in_key") >= min_members).select(*key, "bucket", "run", "island")
    return placed.join(runs, [*key, "bucket", "run"]).select(*rows.columns, "island")


def holes(rows: DataFrame, key: list[str], max_gap: int = MAX_GAP, min_members: int = MIN_MEMBERS) -> DataFrame:
    """A row for each missing number of each island, with its anchor, the last member below it.

    A hole lies between two neighbours, so the lower neighbour is its anchor and the
    numbers come from the step between the two; no join is needed.  Only runs, not
    their members, are put in order within a key.
    """
    whole = Window.partitionBy(*key, "island")
    found = _runs(_placed(rows, key, max_gap), key, max_gap)
    found = (
        found.withColumn("support_n", F.sum("held").over(whole))
        .withColumn("support_total", F.max("hi").over(whole) - F.min("lo").over(whole) + 1)
        .withColumn("max_width", F.max("width").over(whole))
        .withColumn("one_ext", F.min("ext_lo").over(whole) == F.max("ext_hi").over(whole))
    )
    found = found.filter(F.col("support_n") >= min_members)
    joined = F.when(F.col("next_lo") - F.col("hi") <= max_gap, F.col("next_lo"))
    found = found.withColumn("joined", joined).withColumn("edge", F.explode("edges"))
    found = found.withColumn("above", F.coalesce(F.col("edge.next_n"), F.col("joined"))).filter(F.col("above") > F.col("edge.n") + 1)
    missing = F.explode(F.sequence(F.col("edge.n") + 1, F.col("above") - 1)).alias("missing")
    ext = F.when(F.col("one_ext"), F.col("edge.ext")).otherwise("").alias("common_ext")
    return found.select(*key, missing, "max_width", ext, "support_n", "support_total", F.col("edge.path").alias("anchor"))


def _rules(found: DataFrame, strategy: int, group: Column, value: Column, anchors: DataFrame) -> Findings:
    """Rules at their anchor's first entity; without one neither rule nor gap."""
    found = found.join(anchors, "anchor")
    rules = found.select(
        F.lit(strategy).alias("strategy_ord"),
        F.struct(F.lit("0").alias("a"), group.alias("b"), value.alias("c")).alias("emit"),
        group.alias("group_id"),
        F.lit("series").alias("feature_kind"),
        value.alias("feature_value"),
        F.col("support_n").cast("long").alias("support_n"),
        F.col("support_total").cast("long").alias("support_total"),
        (F.col("support_n").cast("double") / F.col("support_total")).alias("confidence"),
        names.rule_id(group, F.lit("series"), value).alias("rule_id"),
        "entity_id",
    )
    return Findings(rules.select(*RULE_COLUMNS), with_gap_ids(rules))


def _first_in_file(entities: DataFrame) -> DataFrame:
    return entities.groupBy(F.col("file_path").alias("anchor")).agg(F.min_by("entity_id", F.struct("ordinal", "entity_id")).alias("entity_id"))


def ancestors(paths: DataFrame) -> DataFrame:
    """``path, dir``: every directory above each path (column ``file_path``)."""
    parts = F.split(names.directory("file_path"), "/")
    chains = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return paths.select("file_path", F.explode(chains).alias("dir")).filter("dir != ''")


def _first_in_directory(entities: DataFrame) -> DataFrame:
    first = entities.groupBy("file_path").agg(F.min(F.struct("ordinal", "entity_id")).alias("e"))
    under = first.join(ancestors(first.select("file_path")), "file_path")
    under = under.groupBy(F.col("dir").alias("anchor")).agg(F.min(F.struct("file_path", "e")).alias("e"))
    return under.select("anchor", F.col("e.e.entity_id").alias("entity_id"))


def _or_dot(c: str) -> Column:
    return F.when(F.col(c) == "", ".").otherwise(F.col(c))


def numbered(paths: DataFrame) -> DataFrame:
    digits = names.leading_number(names.basename("file_path"))
    ext = F.regexp_extract(names.basename("file_path"), r"(\.[^.]+)$", 1)
    rows = paths.select(names.directory("file_path").alias("dir"), digits.alias("digits"), ext.alias("ext"), F.col("file_path").alias("path"))
    rows = rows.filter("digits is not null")
    return rows.select("dir", F.col("digits").cast("long").alias("n"), F.length("digits").alias("width"), "path", "ext")


def series_gaps(entities: DataFrame, *, min_members: int = MIN_MEMBERS, max_gap: int = MAX_GAP) -> Findings:
    """Files named by leading numbers."""
    found = holes(numbered(entities.select("file_path").distinct()), ["dir"], max_gap, min_members)
    value = F.concat(names.zero_padded(F.col("missing"), F.col("max_width")), F.lit("_*"), F.col("common_ext"))
    return _rules(found, SERIES_ORD, F.concat(F.lit("series:"), _or_dot("dir")), value, _first_in_file(entities))


#: Fixed value: how lettered files are named.
_LETTERED = r"^(.+_)([A-Za-z])\.([^.]+)$"


def letter_series_gaps(entities: DataFrame, *, min_members: int = MIN_MEMBERS, max_gap: int = MAX_GAP) -> Findings:
    """Files named ``<prefix>_<letter>.<ext>``, upper and lower case apart."""
    base = names.basename("file_path")
    rows = entities.select("file_path").distinct().filter(base.rlike(_LETTERED))
    letter = F.regexp_extract(base, _LETTERED, 2)
    rows = rows.select(
        names.directory("file_path").alias("dir"),
        F.regexp_extract(base, _LETTERED, 1).alias("prefix"),
        F.regexp_extract(base, _LETTERED, 3).alias("ext"),
        (letter != F.lower(letter)).alias("upper"),
        (F.ascii(F.lower(letter)) - 97).cast("long").alias("n"),
        F.ascii(letter).alias("width"),
        F.col("file_path").alias("path"),
    )
    rows = rows.withColumn("suffix", F.col("ext"))
    found = holes(rows, ["dir", "prefix", "suffix", "upper"], max_gap, min_members)
    char = F.char(F.col("missing") + F.when(F.col("upper"), 65).otherwise(97))
    value = F.concat(F.col("prefix"), char, F.lit("."), F.col("suffix"))
    group = F.concat(F.lit("letter-series:"), _or_dot("dir"), F.lit("::"), F.col("prefix"))
    return _rules(found, LETTER_ORD, group, value, _first_in_file(entities))


_VERSIONED = r"^(.+?)([vV])([0-9]{1,18})$"


def version_directory_gaps(entities: DataFrame, *, min_members: int = MIN_MEMBERS, max_gap: int = MAX_GAP) -> Findings:
    """Directories, at any depth, named ``<prefix>v<number>``."""
    dirs = ancestors(entities.select("file_path").distinct()).select("dir").distinct()
    base = names.basename("dir")
    rows = dirs.filter(base.rlike(_VERSIONED)).select(
        names.directory("dir").alias("parent"),
        F.regexp_extract(base, _VERSIONED, 1).alias("prefix"),
        F.regexp_extract(base, _VERSIONED, 2).alias("marker"),
        F.regexp_extract(base, _VERSIONED, 3).cast("long").alias("n"),
        F.length(F.regexp_extract(base, _VERSIONED, 3)).alias("width"),
        F.col("dir").alias("path"),
        F.lit("").alias("ext"),
    )
    found = holes(rows, ["parent", "prefix", "marker"], max_gap, min_members)
    value = F.concat("prefix", "marker", names.zero_padded(F.col("missing"), F.col("max_width")))
    group = F.concat(F.lit("version-dir:"), _or_dot("parent"), F.lit("::"), F.col("prefix"))
    return _rules(found, VERSION_ORD, group, value, _first_in_directory(entities))


def alphabets(spark: SparkSession, table: list | None = None) -> DataFrame:
    return spark.createDataFrame([(i, *a) for i, a in enumerate(table or ALPHABETS)], f"alphabet_ord int, {ALPHABET}")


def candidate_prefixes(methods: DataFrame) -> DataFrame:
    """``class, prefix_ord, prefix``: none, and the commonest ``x_`` if two names share it."""
    cut = F.concat(F.substring_index("method", "_", 1), F.lit("_"))
    counted = methods.filter(F.instr("method", "_") > 0).groupBy("class", cut.alias("prefix")).agg(F.count("*").alias("n"))
    counted = counted.filter("n >= 2").groupBy("class").agg(F.min_by("prefix", F.struct(-F.col("n"), F.col("prefix"))).alias("prefix"))
    plain = methods.select("class").distinct().select("class", F.lit(0).alias("prefix_ord"), F.lit("").alias("prefix"))
    return plain.unionByName(counted.select("class", F.lit(1).alias("prefix_ord"), "prefix"))


def ordinal_series_gaps(entities: DataFrame, *, table: list | None = None, min_present: float = 0.75) -> Findings:
    """Classes whose methods fill all slots of an alphabet but one; the first alphabet and prefix that does."""
    classes = entities.filter("kind = 'class'").groupBy(F.col("qualified_name").alias("class"))
    classes = classes.agg(F.min_by("entity_id", F.struct("ordinal", "entity_id")).alias("entity_id"))
    q = F.col("qualified_name")
    owner = F.when(F.instr(q, ".") > 0, F.regexp_replace(q, r"\.[^.]*$", "")).otherwise(q)
    methods = entities.filter("kind = 'method'").select(owner.alias("class"), F.substring_index(q, ".", -1).alias("method")).distinct()
    methods = methods.join(classes.select("class"), "class", "left_semi")
    named = methods.join(candidate_prefixes(methods), "class")
    bare = F.when(F.startswith("method", "prefix"), F.expr("substring(method, length(prefix) + 1)")).otherwise(F.col("method"))
    sets = named.groupBy("class", "prefix_ord", "prefix").agg(F.collect_set(bare).alias("have"))
    # a handful of alphabets, a constant of the program
    tried = sets.crossJoin(F.broadcast(alphabets(entities.sparkSession, table)))
    leaf = F.lower(F.substring_index("class", "::", -1))
    hinted = (F.size("hints") == 0) | F.exists("hints", lambda h: F.instr(leaf, h) > 0)
    filled = F.transform("slots", lambda s: F.arrays_overlap(s, F.col("have")))
    tried = tried.filter(hinted).withColumn("filled", filled)
    present = F.size(F.filter("filled", lambda x: x))
    tried = tried.withColumn("present", present).withColumn("total", F.size("slots"))
    enough = F.col("present") >= F.greatest(F.lit(2), F.floor(min_present * F.col("total")))
    tried = tried.filter(enough & (F.col("total") - F.col("present") == 1))
    empty = F.get("slots", (F.array_position("filled", F.lit(False)) - 1).cast("int"))
    tried = tried.withColumn("value", F.concat("prefix", F.get(empty, F.lit(0))))
    first = F.min(F.struct("alphabet_ord", "prefix_ord", "alphabet", "value", "present", "total")).alias("x")
    hits = tried.groupBy("class").agg(first).select("class", "x.*").join(classes, "class")
    group = F.concat(F.lit("ordinal:"), F.col("alphabet"), F.lit("::"), F.col("class"))
    rules = hits.select(
        F.lit(ORDINAL_ORD).alias("strategy_ord"),
        F.struct(F.lit("0").alias("a"), group.alias("b"), F.col("value").alias("c")).alias("emit"),
        group.alias("group_id"),
        F.lit("series").alias("feature_kind"),
        F.col("value").alias("feature_value"),
        F.col("present").cast("long").alias("support_n"),
        F.col("total").cast("long").alias("support_total"),
        (F.col("present").cast("double") / F.col("total")).alias("confidence"),
        names.rule_id(group, F.lit("series"), "value").alias("rule_id"),
        "entity_id",
    )
    return Findings(rules.select(*RULE_COLUMNS), with_gap_ids(rules))
