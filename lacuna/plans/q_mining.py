"""Selectors, frequency mining, pairs, closure, enrichment and what becomes of their findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names
from ..operators import closure, enrichment, finalize, frequency, selectors, symmetry, views
from . import bindings as b
from .book import Book

BOOK = Book()
RULES = ["group_id", "feature_kind", "feature_value", "support_n", "support_total", "confidence", "rule_id"]
GAPS = ["rule_id", "entity_id", "gap_id", "short_id"]

_GROUPED = """,
dirs AS (SELECT regexp_replace(file_path, '/[^/]*$', '') AS name, entity_id FROM ent WHERE kind IN ('function', 'class', 'module')),
mem AS (SELECT 0 AS o, 'directory' AS selector_type, name, 'directory::' || name AS group_id, entity_id FROM dirs
        UNION ALL SELECT 1, 'decorator', value, 'decorator::' || value, entity_id FROM vals
          WHERE kind = 'decorator' AND value NOT IN ('@property', '@staticmethod', '@classmethod')
        UNION ALL SELECT 2, 'parent_class', value, 'parent_class::' || value, v.entity_id FROM vals v JOIN ent e ON e.entity_id = v.entity_id
          WHERE v.kind = 'parent_class' AND value <> 'object' AND e.kind = 'class'),
members AS (SELECT *, n AS n_members FROM (SELECT *, count(*) OVER (PARTITION BY group_id) AS n FROM mem) WHERE n >= 3),
able AS (SELECT m.*, f.kind FROM members m JOIN feats f ON f.entity_id = m.entity_id),
tot AS (SELECT group_id, kind, count(*) AS support_total FROM able GROUP BY 1, 2),
cnt AS (SELECT m.group_id, m.selector_type, m.name, v.kind, v.value, count(*) AS support_n
        FROM members m JOIN vals v ON v.entity_id = m.entity_id GROUP BY 1, 2, 3, 4, 5),
rules AS (SELECT c.group_id, c.kind AS feature_kind, c.value AS feature_value, support_n, support_total,
                 CAST(support_n AS DOUBLE) / support_total AS confidence, c.group_id || '::' || c.kind || '=' || c.value AS rule_id
          FROM cnt c JOIN tot t ON t.group_id = c.group_id AND t.kind = c.kind
          WHERE CAST(support_n AS DOUBLE) / support_total >= 0.8 AND NOT (selector_type = c.kind AND name = c.value)),
gaps AS (SELECT r.*, a.entity_id, r.rule_id || '::' || a.entity_id AS gap_id FROM rules r
         JOIN able a ON a.group_id = r.group_id AND a.kind = r.feature_kind
         WHERE NOT EXISTS (SELECT 1 FROM vals v WHERE v.entity_id = a.entity_id AND v.kind = r.feature_kind AND v.value = r.feature_value)
           AND NOT (r.feature_kind = 'parent_class' AND split_part(a.entity_id, '::', -1) = r.feature_value))
"""
_MEMBERS = f"WITH {b.MARKET_SQL}{_GROUPED}"
_LINES = f"WITH {b.LINES_SQL}{_GROUPED}"
_SHORT = "'g-' || substr(sha256(gap_id), 1, 7) AS short_id"


def _all_members(c) -> DataFrame:
    return selectors.union_groups(
        selectors.directory_groups(c.entities),
        selectors.decorator_groups(c.values),
        selectors.parent_class_groups(c.entities, c.values),
    )


def _market(spark: SparkSession, sf_dir: str):
    c = b.market(spark, sf_dir)
    members = _all_members(c)
    return c, members, frequency.mine(members, c.features, c.values)


@BOOK.add("sel1_market_directory", _MEMBERS + "SELECT group_id, entity_id, n_members FROM members WHERE selector_type = 'directory'")
def sel1(spark, sf_dir):
    return selectors.directory_groups(b.market(spark, sf_dir).entities).select("group_id", "entity_id", "n_members")


@BOOK.add("sel2_market_decorator", _MEMBERS + "SELECT group_id, entity_id, n_members FROM members WHERE selector_type = 'decorator'")
def sel2(spark, sf_dir):
    return selectors.decorator_groups(b.market(spark, sf_dir).values).select("group_id", "entity_id", "n_members")


@BOOK.add("sel3_market_parent", _MEMBERS + "SELECT group_id, entity_id, n_members FROM members WHERE selector_type = 'parent_class'")
def sel3(spark, sf_dir):
    c = b.market(spark, sf_dir)
    return selectors.parent_class_groups(c.entities, c.values).select("group_id", "entity_id", "n_members")


@BOOK.add("sel4_market_groups", _MEMBERS + "SELECT DISTINCT group_id, selector_type, name, n_members FROM members")
def sel4(spark, sf_dir):
    return selectors.groups(_all_members(b.market(spark, sf_dir))).select("group_id", "selector_type", "name", "n_members")


@BOOK.add("fil1_kind_fil2_exclude", f"WITH {b.MARKET_SQL} SELECT v.entity_id, v.value FROM vals v JOIN ent e ON e.entity_id = v.entity_id WHERE e.kind = 'class' AND v.kind = 'parent_class' AND v.value NOT IN ('ASIA', 'EUROPE')")
def fil1(spark, sf_dir):
    c = b.market(spark, sf_dir)
    rows = c.values.filter("kind = 'parent_class'").join(c.entities.filter("kind = 'class'").select("entity_id"), "entity_id", "left_semi")
    return rows.filter(~F.col("value").isin("ASIA", "EUROPE")).select("entity_id", "value")


@BOOK.add("min1_value_counts", _MEMBERS + "SELECT kind, value, count(*) AS n FROM vals GROUP BY 1, 2")
def min1(spark, sf_dir):
    return frequency.value_counts(b.market(spark, sf_dir).values)


@BOOK.add("min2_pruned_values", _MEMBERS + "SELECT v.* FROM vals v JOIN (SELECT kind, value FROM vals GROUP BY 1, 2 HAVING count(*) >= 2) k ON k.kind = v.kind AND k.value = v.value")
def min2(spark, sf_dir):
    return frequency.pruned(b.market(spark, sf_dir).values, 1.0)


@BOOK.add("min3_eligible_totals", _MEMBERS + "SELECT * FROM tot")
def min3(spark, sf_dir):
    c = b.market(spark, sf_dir)
    able = frequency.eligible(_all_members(c), c.features)
    return able.groupBy("group_id", "kind").agg(F.count("*").alias("support_total"))


@BOOK.add("min4_group_counts", _MEMBERS + "SELECT group_id, kind, value, support_n FROM cnt")
def min4(spark, sf_dir):
    c = b.market(spark, sf_dir)
    found = frequency.group_counts(_all_members(c), c.features, c.values)
    return found.select("group_id", "kind", "value", "support_n")


@BOOK.add("min5_rules", _MEMBERS + "SELECT * FROM rules")
def min5(spark, sf_dir):
    return _market(spark, sf_dir)[2].rules.select(*RULES)


@BOOK.add("min6_gaps", _MEMBERS + f"SELECT rule_id, entity_id, gap_id, {_SHORT} FROM gaps")
def min6(spark, sf_dir):
    return _market(spark, sf_dir)[2].gaps.select(*GAPS)


@BOOK.add("min8_per_kind", _MEMBERS + "SELECT r.feature_kind, count(DISTINCT r.rule_id) AS rules, count(g.gap_id) AS gaps FROM rules r LEFT JOIN gaps g ON g.rule_id = r.rule_id GROUP BY 1")
def min8(spark, sf_dir):
    found = _market(spark, sf_dir)[2]
    rules = found.rules.groupBy("feature_kind").agg(F.countDistinct("rule_id").alias("rules"))
    gaps = found.gaps.groupBy("feature_kind").agg(F.count("*").alias("gaps"))
    return rules.join(gaps, "feature_kind", "left").select("feature_kind", "rules", F.coalesce("gaps", F.lit(0)).alias("gaps"))


_DEDUP = """, dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, feature_value ORDER BY confidence DESC,
  array_position(['decorator', 'calls', 'parent_class', 'has_docstring'], feature_kind), split_part(group_id, '::', 1) <> 'directory',
  split_part(group_id, '::', 1) <> 'decorator', group_id, feature_value) AS nth FROM gaps) WHERE nth = 1)
"""
# has_docstring follows sibling_test in the mined order, and nothing lies between for these kinds


@BOOK.add("fin4_cust_gaps", _MEMBERS + _DEDUP + f"SELECT entity_id, feature_value, rule_id, confidence, gap_id, {_SHORT} FROM dd")
def fin4(spark, sf_dir):
    gaps = finalize.dedup_gaps(_market(spark, sf_dir)[2].gaps)
    return gaps.select("entity_id", "feature_value", "rule_id", "confidence", "gap_id", "short_id")


@BOOK.add(
    "fin3_ranked",
    _MEMBERS
    + """SELECT gap_id, row_number() OVER (ORDER BY confidence DESC, array_position(['decorator', 'calls', 'parent_class', 'has_docstring'], feature_kind),
  split_part(group_id, '::', 1) <> 'directory', split_part(group_id, '::', 1) <> 'decorator', split_part(group_id, '::', 2), feature_value, entity_id) AS place FROM gaps""",
)
def fin3(spark, sf_dir):
    rows = finalize.ranked(_market(spark, sf_dir)[2].gaps).select("gap_id", F.monotonically_increasing_id().alias("at"))
    return rows.select("gap_id", F.row_number().over(Window.orderBy("at")).cast("long").alias("place"))


@BOOK.add(
    "fin9_exit_codes",
    _MEMBERS + ", n AS (SELECT count(*) AS n FROM gaps) SELECT coalesce(CAST(m AS VARCHAR), 'unset') AS max_gaps, CAST(n > coalesce(m, 0) AS INT) AS code FROM n, (VALUES (NULL), (0), (50), (1000000000)) AS v(m)",
)
def fin9(spark, sf_dir):
    n = _market(spark, sf_dir)[2].gaps.count()
    return spark.createDataFrame([("unset" if m is None else str(m), finalize.exit_code(n, m)) for m in (None, 0, 50, 1_000_000_000)], "max_gaps string, code int")


@BOOK.add("fin2_rules_by_id", _MEMBERS + "SELECT rule_id, confidence, support_n FROM rules")
def fin2(spark, sf_dir):
    found = _market(spark, sf_dir)[2]
    return finalize.rules_by_id(found.rules.unionByName(found.rules)).select("rule_id", "confidence", "support_n")


@BOOK.add("fin5_local_suppressions", _MEMBERS + "SELECT gap_id FROM gaps WHERE substr(sha256(gap_id), 1, 1) NOT IN ('0', '1')")
def fin5(spark, sf_dir):
    gaps = _market(spark, sf_dir)[2].gaps
    listed = gaps.filter(F.substring("short_id", 3, 1).isin("0", "1"))
    by_short = F.when(F.substring("short_id", 3, 1) == "0", F.col("short_id"))
    listed = listed.select(by_short.alias("short_id"), F.when(by_short.isNull(), F.col("gap_id")).alias("full_id"))
    return finalize.suppress_local(gaps, listed).select("gap_id")


PROJECT = [
    (None, "@3-MEDIUM", "rule_global", "known"),
    ("seg/BUILDING/c.tbl::c7", None, None, "one entity"),
    ("seg/BUILDING/c.tbl::c8", "docstring", "GAP", "one entity and value"),
    ("seg/FURNITURE/c.tbl::c9", "no such rule", "gap", "does not match"),
    (None, None, "rule_global", "needs a rule"),
    ("seg/MACHINERY/c.tbl::c10", None, "elsewhere", "unknown scope"),
]


@BOOK.add(
    "fin6_project_suppressions",
    _MEMBERS
    + """SELECT gap_id FROM gaps WHERE NOT (feature_value = '@3-MEDIUM' OR rule_id = '@3-MEDIUM' OR entity_id = 'seg/BUILDING/c.tbl::c7'
  OR (entity_id = 'seg/BUILDING/c.tbl::c8' AND (feature_value = 'docstring' OR rule_id = 'docstring')))""",
)
def fin6(spark, sf_dir):
    entries = spark.createDataFrame(PROJECT, "entity string, rule string, scope string, reason string")
    return finalize.suppress_project(_market(spark, sf_dir)[2].gaps, entries).select("gap_id")


@BOOK.add(
    "fin8_scan_statistics",
    _MEMBERS
    + """SELECT (SELECT count(*) FROM ent) AS entities, (SELECT count(DISTINCT file_path) FROM ent) AS files,
  (SELECT count(DISTINCT group_id) FROM members) AS groups, (SELECT count(*) FROM rules) AS rules,
  (SELECT count(*) FROM gaps) AS gaps, (SELECT count(DISTINCT rule_id) FROM gaps) AS rules_with_gaps""",
)
def fin8(spark, sf_dir):
    c, members, found = _market(spark, sf_dir)
    return finalize.scan_statistics(c.entities, selectors.groups(members), found.rules, found.gaps)


_PAIRS = """,
counts AS (SELECT scope, name, count(*) AS n FROM idx GROUP BY 1, 2),
together AS (SELECT a.scope, a.name AS l, c.name AS r, count(*) AS n_both FROM idx a JOIN idx c
         ON a.scope = c.scope AND a.scope_id = c.scope_id AND a.name <> c.name GROUP BY 1, 2, 3),
dirs AS (SELECT t.scope, l, r, n_both, n AS n_left FROM together t JOIN counts k ON k.scope = t.scope AND k.name = t.l
         WHERE n >= {least} AND CAST(n_both AS DOUBLE) / n >= {conf} AND n_both < n),
gaps AS (SELECT d.*, i.entity_id FROM dirs d JOIN idx i ON i.scope = d.scope AND i.name = d.l
         WHERE NOT EXISTS (SELECT 1 FROM idx j WHERE j.scope = i.scope AND j.scope_id = i.scope_id AND j.name = d.r))
"""
_SYM = f"WITH {b.BASKETS_SQL}, idx AS (SELECT scope, scope_id, name, entity_id FROM ent)" + _PAIRS.format(least=3, conf=0.8)
_TALK = f"WITH {b.DIALOGUES_SQL}, idx AS (SELECT scope, scope_id, name, entity_id FROM ent)" + _PAIRS.format(least=3, conf=0.8)
_SYM_RULES = """SELECT 'symmetry:mined:' || l || '_to_' || r AS group_id, 'symmetry' AS feature_kind, r AS feature_value, n_both AS support_n,
  n_left AS support_total, CAST(n_both AS DOUBLE) / n_left AS confidence,
  'symmetry:mined:' || l || '_to_' || r || '::symmetry=' || r AS rule_id FROM dirs"""
_SYM_GAPS = "SELECT 'symmetry:mined:' || l || '_to_' || r || '::symmetry=' || r AS rule_id, entity_id FROM gaps"


@BOOK.add("sym2_scope_index", f"WITH {b.DIALOGUES_SQL} SELECT scope, scope_id, name, entity_id FROM ent")
def sym2(spark, sf_dir):
    return symmetry.scope_index(b.dialogues(spark, sf_dir))


@BOOK.add("sym3_name_counts", _SYM + "SELECT * FROM counts")
def sym3(spark, sf_dir):
    return symmetry.name_counts(symmetry.scope_index(b.baskets(spark, sf_dir)))


@BOOK.add("sym5_pair_counts", _SYM + "SELECT scope, l AS a, r AS b, n_both FROM together WHERE l < r AND (l IN (SELECT name FROM counts WHERE n >= 3) OR r IN (SELECT name FROM counts WHERE n >= 3))")
def sym5(spark, sf_dir):
    return symmetry.qualifying_pairs(symmetry.scope_index(b.baskets(spark, sf_dir)), 3)


@BOOK.add("sym7_mined_pairs", _TALK + "SELECT 'mined:' || l || '_to_' || r AS name, l AS left_name, r AS right_name, scope FROM dirs")
def sym7(spark, sf_dir):
    found = symmetry.mine_pairs(b.dialogues(spark, sf_dir))
    return found.select("name", F.col("left").alias("left_name"), F.col("right").alias("right_name"), "scope")


@BOOK.add("sym8_basket_rules", _SYM + _SYM_RULES)
def sym8_rules(spark, sf_dir):
    return symmetry.symmetry_gaps(b.baskets(spark, sf_dir)).rules.select(*RULES)


@BOOK.add("sym8_basket_gaps", _SYM + _SYM_GAPS)
def sym8_gaps(spark, sf_dir):
    return symmetry.symmetry_gaps(b.baskets(spark, sf_dir)).gaps.select("rule_id", "entity_id")


@BOOK.add("fin1_union", f"SELECT rule_id, entity_id FROM ({_MEMBERS} SELECT rule_id, entity_id FROM gaps) UNION ALL SELECT * FROM ({_SYM}{_SYM_GAPS})")
def fin1(spark, sf_dir):
    found = finalize.union_findings([_market(spark, sf_dir)[2], symmetry.symmetry_gaps(b.baskets(spark, sf_dir))])
    return found.gaps.select("rule_id", "entity_id")


@BOOK.add("sym8_dialogue_gaps", _TALK + _SYM_GAPS)
def sym8_talk(spark, sf_dir):
    return symmetry.symmetry_gaps(b.dialogues(spark, sf_dir)).gaps.select("rule_id", "entity_id")


@BOOK.add(
    "sym9_custom_pair",
    _TALK
    + """SELECT 'symmetry:ask::symmetry=assistant' AS rule_id, i.entity_id FROM idx i WHERE scope = 'class' AND name = 'user'
  AND NOT EXISTS (SELECT 1 FROM idx j WHERE j.scope = 'class' AND j.scope_id = i.scope_id AND j.name = 'assistant')""",
)
def sym9(spark, sf_dir):
    pairs = spark.createDataFrame([("ask", "user", "assistant", "class", "questions are answered")], symmetry.PAIR)
    return symmetry.symmetry_gaps(b.dialogues(spark, sf_dir), pairs).gaps.select("rule_id", "entity_id")


_CPR = f"WITH {b.MARKET_SQL}, idx AS (SELECT 'caller' AS scope, v.entity_id AS scope_id, value AS name, v.entity_id FROM vals v JOIN ent e ON e.entity_id = v.entity_id WHERE v.kind = 'calls' AND e.kind IN ('function', 'method'))" + _PAIRS.format(least=5, conf=0.9)


@BOOK.add("cpr2_call_counts", _CPR + "SELECT name AS call, n FROM counts WHERE n >= 5")
def cpr2(spark, sf_dir):
    c = b.market(spark, sf_dir)
    calls = symmetry.callers(c.entities, c.values)
    return calls.groupBy("call").agg(F.count("*").alias("n")).filter("n >= 5")


@BOOK.add("cpr4_rules", _CPR + "SELECT 'call_pair:' || l AS group_id, 'call_pair' AS feature_kind, r AS feature_value, n_both AS support_n, n_left AS support_total, CAST(n_both AS DOUBLE) / n_left AS confidence, 'call_pair:' || l || '::call_pair=' || r AS rule_id FROM dirs WHERE r IN (SELECT name FROM counts WHERE n >= 5)")
def cpr4(spark, sf_dir):
    c = b.market(spark, sf_dir)
    return symmetry.call_pair_gaps(c.entities, c.values).rules.select(*RULES)


@BOOK.add("cpr5_gaps", _CPR + "SELECT 'call_pair:' || l || '::call_pair=' || r AS rule_id, entity_id FROM gaps WHERE r IN (SELECT name FROM counts WHERE n >= 5)")
def cpr5(spark, sf_dir):
    c = b.market(spark, sf_dir)
    return symmetry.call_pair_gaps(c.entities, c.values).gaps.select("rule_id", "entity_id")


_PAPERS = """WITH un AS (SELECT 'docs/d' || doc_id || '.tbl' AS p, 'Doc' || doc_id AS name FROM documents
  WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL))
"""


@BOOK.add("clo1_referenced_names", "WITH c AS (SELECT DISTINCT doc_id AS k FROM labels) SELECT 'Doc' || k AS name FROM c UNION ALL SELECT 'store.Doc' || k FROM c")
def clo1(spark, sf_dir):
    return closure.referenced_names(b.papers(spark, sf_dir).values)


@BOOK.add("clo3_unreferenced", _PAPERS + "SELECT p || '::' || name AS entity_id, name, p AS file_path FROM un")
def clo3(spark, sf_dir):
    c = b.papers(spark, sf_dir)
    return closure.unreferenced(c.entities, c.features, c.values).select("entity_id", "name", "file_path")


@BOOK.add("clo6_gaps", _PAPERS + "SELECT 'closure:' || p || '::closure=' || name || ' (defined but never used)' AS rule_id, p || '::' || name AS entity_id, CAST(1 AS DOUBLE) AS confidence FROM un")
def clo6(spark, sf_dir):
    c = b.papers(spark, sf_dir)
    return closure.unused_class_gaps(c.entities, c.features, c.values).gaps.select("rule_id", "entity_id", "confidence")


_TOKENS = """WITH bt AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[^A-Za-z0-9_]+')) AS name FROM benchmark),
cand AS (SELECT name FROM bt WHERE regexp_matches(name, '^[A-Za-z]')),
tok AS (SELECT name, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[^A-Za-z0-9_]+')) AS name FROM documents) WHERE name IN (SELECT name FROM cand) GROUP BY 1)
"""


def _words(spark, sf_dir):
    words = b.table(spark, sf_dir, "benchmark").select(F.explode(names.identifiers("text")).alias("name")).distinct()
    return words.filter(~F.col("name").startswith("_"))


@BOOK.add("clo4_token_counts", _TOKENS + "SELECT name, n FROM tok")
def clo4(spark, sf_dir):
    return closure.token_counts(b.table(spark, sf_dir, "documents"), _words(spark, sf_dir))


@BOOK.add("clo5_unused_words", _TOKENS + "SELECT 'words.txt::' || cand.name AS entity_id FROM cand LEFT JOIN tok ON tok.name = cand.name WHERE coalesce(n, 0) <= 1")
def clo5(spark, sf_dir):
    entities = b.entity(_words(spark, sf_dir), "class", F.lit("words.txt"), F.col("name"), F.lit(0))
    empty = spark.createDataFrame([], "entity_id string, kind string, value string")
    return closure.unused_class_gaps(entities, empty, empty, b.table(spark, sf_dir, "documents")).gaps.select("entity_id")


_SIB = """WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s, 'd' || (o_custkey % 50) || '/' AS d, 'm' || (o_orderkey % 40) || '.py' AS f FROM orders),
t AS (SELECT d, f, k FROM o WHERE s = 'F')
"""


@BOOK.add("enr1_test_index", _SIB + "SELECT DISTINCT 'tests/' || d || 'test_' || f AS test_file, 'test_f' || k AS name FROM t")
def enr1(spark, sf_dir):
    return enrichment.test_index(b.modules(spark, sf_dir))


@BOOK.add("enr2_sibling_tests", _SIB + "SELECT 'src/' || o.d || o.f || '::f' || o.k AS entity_id, EXISTS (SELECT 1 FROM t WHERE t.d = o.d AND t.f = o.f AND t.k = o.k) AS tested FROM o")
def enr2(spark, sf_dir):
    features, values = enrichment.sibling_tests(b.modules(spark, sf_dir))
    found = features.select("entity_id").join(values.select("entity_id", F.lit(True).alias("tested")), "entity_id", "left")
    return found.select("entity_id", F.coalesce("tested", F.lit(False)).alias("tested"))


@BOOK.add(
    "enr3_candidate_ids",
    _SIB
    + """SELECT entity_id, c || '::test_f' || k AS candidate FROM (SELECT 'src/' || d || f || '::f' || k AS entity_id, k, unnest([
  'tests/' || d || 'test_' || f, 'tests/' || d || replace(f, '.py', '_test.py'), 'tests/src/' || d || 'test_' || f, 'tests/src/' || d || replace(f, '.py', '_test.py'),
  'tests/test_' || f, 'tests/' || replace(f, '.py', '_test.py'), 'src/' || d || 'test_' || f, 'src/' || d || replace(f, '.py', '_test.py')]) AS c FROM o)""",
)
def enr3(spark, sf_dir):
    rows = b.modules(spark, sf_dir).filter(F.col("file_path").startswith("src/"))
    return enrichment.candidate_test_ids(rows)


REGISTERED = [("n1/s.tbl", "S1"), ("n3/s.tbl", "S12"), ("s.tbl", "S20")]


@BOOK.add(
    "enr5_entry_points",
    f"""WITH {b.MARKET_SQL}, reg(suffix, class) AS (VALUES ('n1/s.tbl', 'S1'), ('n3/s.tbl', 'S12'), ('s.tbl', 'S20')),
hit AS (SELECT DISTINCT entity_id, file_path FROM ent JOIN reg ON ends_with(file_path, suffix) AND ends_with(entity_id, '::' || class) WHERE kind = 'class')
SELECT e.entity_id, e.entity_id IN (SELECT entity_id FROM hit) AS registered FROM ent e
WHERE kind = 'class' AND regexp_replace(file_path, '/[^/]*$', '') IN (SELECT regexp_replace(file_path, '/[^/]*$', '') FROM hit)
  AND e.entity_id NOT IN (SELECT entity_id FROM vals WHERE kind = 'parent_class' AND value IN ('ABC', 'abc.ABC'))""",
)
def enr5(spark, sf_dir):
    c = b.market(spark, sf_dir)
    registered = spark.createDataFrame(REGISTERED, "suffix string, class string")
    features, values = enrichment.entry_points(c.entities, c.values, registered)
    found = features.select("entity_id").join(values.select("entity_id", F.lit(True).alias("registered")), "entity_id", "left")
    return found.select("entity_id", F.coalesce("registered", F.lit(False)).alias("registered"))


@BOOK.add(
    "enr6_enriched",
    f"""WITH {b.MARKET_SQL}, reg(suffix, class) AS (VALUES ('n1/s.tbl', 'S1'), ('n3/s.tbl', 'S12'), ('s.tbl', 'S20')),
hit AS (SELECT DISTINCT entity_id, file_path FROM ent JOIN reg ON ends_with(file_path, suffix) AND ends_with(entity_id, '::' || class) WHERE kind = 'class'),
near AS (SELECT entity_id FROM ent WHERE kind = 'class' AND regexp_replace(file_path, '/[^/]*$', '') IN (SELECT regexp_replace(file_path, '/[^/]*$', '') FROM hit)),
f AS (SELECT entity_id, kind FROM feats UNION ALL SELECT entity_id, 'sibling_test' FROM ent WHERE kind = 'function' UNION ALL SELECT entity_id, 'entry_point_registered' FROM near),
v AS (SELECT entity_id, kind, value FROM vals UNION ALL SELECT entity_id, 'entry_point_registered', 'registered' FROM near WHERE entity_id IN (SELECT entity_id FROM hit))
SELECT f.entity_id, f.kind, v.value FROM f LEFT JOIN v ON v.entity_id = f.entity_id AND v.kind = f.kind""",
)
def enr6(spark, sf_dir):
    found = enrichment.enrich(b.market(spark, sf_dir), spark.createDataFrame(REGISTERED, "suffix string, class string"))
    return found.features.join(found.values, ["entity_id", "kind"], "left").select("entity_id", "kind", "value")


@BOOK.add("view4_kind_histogram", f"WITH {b.MARKET_SQL} SELECT kind, count(*) AS n FROM ent GROUP BY 1")
def view4(spark, sf_dir):
    return views.kind_histogram(b.market(spark, sf_dir).entities)


_PER_GROUP = _MEMBERS + """, gr AS (SELECT DISTINCT o, group_id, name, n_members FROM members),
pg AS (SELECT gr.*, (SELECT count(*) FROM rules r WHERE r.group_id = gr.group_id) AS n_rules, (SELECT count(*) FROM gaps g WHERE g.group_id = gr.group_id) AS n_gaps FROM gr)
"""


@BOOK.add("view5_per_group", _PER_GROUP + "SELECT group_id, n_members, n_rules, n_gaps FROM pg")
def view5(spark, sf_dir):
    _, members, found = _market(spark, sf_dir)
    return views.per_group(selectors.groups(members), found.rules, found.gaps).select("group_id", "n_members", "n_rules", "n_gaps")


@BOOK.add("view6_top_groups", _PER_GROUP + "SELECT group_id, n_rules FROM pg ORDER BY n_rules DESC, o, name LIMIT 5")
def view6(spark, sf_dir):
    _, members, found = _market(spark, sf_dir)
    return views.top_groups(selectors.groups(members), found.rules, found.gaps).select("group_id", "n_rules")


@BOOK.add("view1_fil14_gaps", _MEMBERS + f"SELECT gap_id, {_SHORT}, g.entity_id, e.file_path, confidence FROM gaps g JOIN ent e ON e.entity_id = g.entity_id WHERE lower('g-' || substr(sha256(gap_id), 1, 7) || ' ' || e.file_path || ' ' || e.qualified_name || ' ' || feature_value) LIKE '%furn%'")
def view1(spark, sf_dir):
    c, _, found = _market(spark, sf_dir)
    rows = views.sort_gaps(views.filter_gaps(found.gaps, c.entities, "FURN"), "file")
    return rows.select("gap_id", "short_id", "entity_id", "file_path", "confidence")


@BOOK.add("view2_fil15_rules", _MEMBERS + "SELECT rule_id, support_n, confidence FROM rules WHERE lower(rule_id || ' ' || group_id || ' ' || feature_value || ' ' || printf('%.2f', confidence)) LIKE '%urgent%'")
def view2(spark, sf_dir):
    rows = views.sort_rules(views.filter_rules(_market(spark, sf_dir)[2].rules, "Urgent"), "support_desc")
    return rows.select("rule_id", "support_n", "confidence")


@BOOK.add("view3_fil16_groups", _MEMBERS + "SELECT DISTINCT group_id, n_members FROM members WHERE lower(group_id || ' ' || selector_type) LIKE '%parent%'")
def view3(spark, sf_dir):
    return views.sort_groups(views.filter_groups(selectors.groups(_all_members(b.market(spark, sf_dir))), "PARENT")).select("group_id", "n_members")


@BOOK.add("view9_rule_detail", _MEMBERS + "SELECT r.rule_id, a.entity_id, EXISTS (SELECT 1 FROM vals v WHERE v.entity_id = a.entity_id AND v.kind = r.feature_kind AND v.value = r.feature_value) AS exhibits FROM rules r JOIN able a ON a.group_id = r.group_id AND a.kind = r.feature_kind")
def view9(spark, sf_dir):
    c, members, found = _market(spark, sf_dir)
    return views.rule_detail(members, c.features, c.values, found.rules)


@BOOK.add("view10_group_detail", _MEMBERS + "SELECT m.entity_id, e.file_path FROM members m JOIN ent e ON e.entity_id = m.entity_id WHERE group_id = 'directory::seg/BUILDING'")
def view10(spark, sf_dir):
    c = b.market(spark, sf_dir)
    return views.group_detail(_all_members(c), c.entities, "directory::seg/BUILDING").select("entity_id", "file_path")


_DIFF = _MEMBERS + ", old AS (SELECT gap_id FROM gaps WHERE feature_kind <> 'calls'), new AS (SELECT gap_id FROM gaps WHERE feature_kind <> 'has_docstring') "


@BOOK.add("view12_scan_diff", _DIFF + "SELECT gap_id, 'added' AS change FROM new WHERE gap_id NOT IN (SELECT gap_id FROM old) UNION ALL SELECT gap_id, 'removed' FROM old WHERE gap_id NOT IN (SELECT gap_id FROM new)")
def view12(spark, sf_dir):
    gaps = _market(spark, sf_dir)[2].gaps
    return views.scan_diff(gaps.filter("feature_kind <> 'calls'"), gaps.filter("feature_kind <> 'has_docstring'"), "gap_id")


@BOOK.add("view7_drill", _MEMBERS + f", one AS (SELECT *, {_SHORT} FROM gaps QUALIFY row_number() OVER (ORDER BY gap_id) = 1) SELECT gap_id, group_id, (SELECT min(entity_id) FROM members m WHERE m.group_id = one.group_id) AS first_member FROM one")
def view7(spark, sf_dir):
    _, members, found = _market(spark, sf_dir)
    first = found.gaps.orderBy("gap_id").select("short_id").head()
    return views.drill(found.gaps, members, first.short_id if first else "").select("gap_id", "group_id", "first_member")


@BOOK.add("view8_suppressions", "SELECT * FROM (VALUES ('g-0', 'full', 'why', 'local'), ('rule_global', '@3-MEDIUM', 'known', 'project'), ('gap', 'seg/BUILDING/c.tbl::c7', 'one entity', 'project'), ('GAP', 'seg/BUILDING/c.tbl::c8 docstring', 'one entity and value', 'project'), ('gap', 'seg/FURNITURE/c.tbl::c9 no such rule', 'does not match', 'project'), ('rule_global', '', 'needs a rule', 'project'), ('elsewhere', 'seg/MACHINERY/c.tbl::c10', 'unknown scope', 'project')) t(label, target, reason, source)")
def view8(spark, sf_dir):
    local = spark.createDataFrame([("g-0", "full", "why")], "short_id string, full_id string, reason string")
    return views.suppressions_view(local, spark.createDataFrame(PROJECT, "entity string, rule string, scope string, reason string"))


def _lines(spark, sf_dir):
    c = b.lines(spark, sf_dir)
    members = selectors.union_groups(selectors.directory_groups(c.entities), selectors.decorator_groups(c.values))
    return frequency.mine(members, c.features, c.values)


@BOOK.add("min5_line_rules", _LINES + "SELECT * FROM rules")
def min5_lines(spark, sf_dir):
    return _lines(spark, sf_dir).rules.select(*RULES)


@BOOK.add("min6_line_gaps", _LINES + f"SELECT rule_id, entity_id, gap_id, {_SHORT} FROM gaps")
def min6_lines(spark, sf_dir):
    return _lines(spark, sf_dir).gaps.select(*GAPS)
