"""Series detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series
from . import bindings as b
from .book import Book

BOOK = Book()
_COLUMNS = ["group_id", "feature_value", "support_n", "support_total", "confidence", "rule_id", "entity_id"]

_FILES = """WITH m AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n,
  'ord/' || l_orderkey || '/' || lpad(CAST(l_linenumber AS VARCHAR), 4, '0') || '_' || l_partkey || '_' || l_suppkey || '.tbl' AS path FROM lineitem),
m2 AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY path) AS tie FROM m),
"""


def _holes(gap: int) -> str:
    return b.HOLES_SQL.format(gap=gap).replace("FROM m)", "FROM m2)")


_VALUE = "lpad(CAST(missing AS VARCHAR), 4, '0') || '_*.tbl'"
_REPORT = """SELECT {g} AS group_id, {v} AS feature_value, support_n, CAST(support_total AS BIGINT) AS support_total, CAST(support_n AS DOUBLE) / support_total AS confidence,
  {g} || '::series=' || {v} AS rule_id, {e} AS entity_id FROM hole"""


def _findings(found):
    return found.gaps.select(*_COLUMNS)


@BOOK.add("ser4_order_clusters", _FILES + _holes(1) + "SELECT 'ord/' || k AS dir, path, CAST(island AS BIGINT) AS island FROM i")
def ser4(spark, sf_dir):
    rows = series.numbered(b.line_files(spark, sf_dir).select("file_path"))
    return series.clusters(rows, ["dir"], max_gap=1).select("dir", "path", "island")


@BOOK.add("ser1_order_numbers", _FILES + _holes(5) + _REPORT.format(g="'series:ord/' || k", v=_VALUE, e="anchor || '::f'"))
def ser1(spark, sf_dir):
    return _findings(series.series_gaps(b.line_files(spark, sf_dir)))


@BOOK.add("ser1_order_numbers_close", _FILES + _holes(2) + _REPORT.format(g="'series:ord/' || k", v=_VALUE, e="anchor || '::f'"))
def ser1_close(spark, sf_dir):
    return _findings(series.series_gaps(b.line_files(spark, sf_dir), max_gap=2))


@BOOK.add("ser6_missing_numbers", _FILES + _holes(5) + "SELECT 'ord/' || k AS dir, CAST(missing AS BIGINT) AS missing, anchor FROM hole")
def ser6(spark, sf_dir):
    return series.holes(series.numbered(b.line_files(spark, sf_dir).select("file_path")), ["dir"]).select("dir", "missing", "anchor")


_LETTERS = """WITH m AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n, 'ord/' || l_orderkey || '/part_' || chr(96 + l_linenumber) || '.tbl' AS path FROM lineitem),
m2 AS (SELECT *, 0 AS tie FROM m),
"""


@BOOK.add("ser2_order_letters", _LETTERS + _holes(5) + _REPORT.format(g="'letter-series:ord/' || k || '::part_'", v="'part_' || chr(CAST(96 + missing AS INTEGER)) || '.tbl'", e="anchor || '::f'"))
def ser2(spark, sf_dir):
    return _findings(series.letter_series_gaps(b.lettered_files(spark, sf_dir)))


_VERSIONS = """WITH m AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n, 'ord/' || l_orderkey || '/lot_v' || l_linenumber AS path FROM lineitem),
m2 AS (SELECT *, 0 AS tie FROM m),
"""


@BOOK.add("ser3_order_versions", _VERSIONS + _holes(5) + _REPORT.format(g="'version-dir:ord/' || k || '::lot_'", v="'lot_v' || missing", e="anchor || '/x.tbl::f'"))
def ser3(spark, sf_dir):
    return _findings(series.version_directory_gaps(b.version_dirs(spark, sf_dir)))


@BOOK.add("ser9_ancestors", "SELECT DISTINCT 'ord/' || l_orderkey || '/lot_v' || l_linenumber AS dir FROM lineitem UNION SELECT DISTINCT 'ord/' || l_orderkey FROM lineitem UNION SELECT 'ord'")
def ser9(spark, sf_dir):
    return series.ancestors(b.version_dirs(spark, sf_dir).select("file_path")).select("dir").distinct()


_VISITS = """WITH v AS (SELECT DISTINCT user_id, strftime(ts, '%Y%m%d') AS day, event_type FROM events),
f AS (SELECT user_id, day, max(CAST(event_type IN ('signup', 'login') AS INT)) AS a, max(CAST(event_type IN ('view', 'click') AS INT)) AS b,
             max(CAST(event_type = 'purchase' AS INT)) AS c FROM v GROUP BY 1, 2)
SELECT 'ordinal:funnel::ev/u' || user_id || '.log::D' || day AS group_id,
       CASE WHEN a = 0 THEN 'signup' WHEN b = 0 THEN 'view' ELSE 'purchase' END AS feature_value,
       'ev/u' || user_id || '.log::D' || day AS entity_id, CAST(2 AS BIGINT) AS support_n, CAST(3 AS BIGINT) AS support_total FROM f WHERE a + b + c = 2
"""


@BOOK.add("ser10_visit_alphabet", _VISITS)
def ser10(spark, sf_dir):
    found = series.ordinal_series_gaps(b.visits(spark, sf_dir), table=b.VISIT_ALPHABET)
    return found.gaps.select("group_id", "feature_value", "entity_id", "support_n", "support_total")


@BOOK.add("ser13_prefixes", "SELECT DISTINCT 'ev/u' || user_id || '.log::D' || strftime(ts, '%Y%m%d') AS class, 0 AS prefix_ord, '' AS prefix FROM events")
def ser13(spark, sf_dir):
    rows = b.visits(spark, sf_dir).filter("kind = 'method'")
    methods = rows.select(F.substring_index("qualified_name", ".", 2).alias("class"), F.substring_index("qualified_name", ".", -1).alias("method"))
    return series.candidate_prefixes(methods)
