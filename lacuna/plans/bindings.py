"""The driver's tables as entities and features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import Corpus

ENTITY_COLUMNS = ["entity_id", "kind", "qualified_name", "file_path", "line", "ordinal"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entity(rows: DataFrame, kind: str, path, name, ordinal) -> DataFrame:
    """Entity rows named ``path::name``."""
    return rows.select(
        F.concat(path, F.lit("::"), name).alias("entity_id"),
        F.lit(kind).alias("kind"),
        F.concat(path, F.lit("::"), name).alias("qualified_name"),
        path.alias("file_path"),
        F.lit(1).alias("line"),
        ordinal.cast("long").alias("ordinal"),
    )


def _text(*parts) -> F.Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) and not p.startswith("$") else F.col(p[1:]).cast("string") for p in parts])


def market(spark: SparkSession, sf_dir: str) -> Corpus:
    """Customers as functions in their segment's directory, suppliers as classes of nation and region."""
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    supplier, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    c_path, c_name = _text("seg/", "$c_mktsegment", "/c.tbl"), _text("c", "$c_custkey")
    s_path, s_name = _text("sup/n", "$s_nationkey", "/s.tbl"), _text("S", "$s_suppkey")
    entities = entity(customer, "function", c_path, c_name, F.col("c_custkey")).unionByName(
        entity(supplier, "class", s_path, s_name, F.col("s_suppkey"))
    )
    bought = customer.join(orders, F.col("o_custkey") == F.col("c_custkey"))
    c_id, s_id = F.concat(c_path, F.lit("::"), c_name), F.concat(s_path, F.lit("::"), s_name)
    places = supplier.join(nation, F.col("n_nationkey") == F.col("s_nationkey")).join(region, F.col("r_regionkey") == F.col("n_regionkey"))

    def rows(of: DataFrame, key, kind: str, value) -> DataFrame:
        return of.select(key.alias("entity_id"), F.lit(kind).alias("kind"), value.alias("value"))

    values = [
        rows(bought, c_id, "decorator", _text("@", "$o_orderpriority")).distinct(),
        rows(bought, c_id, "calls", F.col("o_orderstatus")).distinct(),
        rows(customer.filter("c_acctbal > 0"), c_id, "has_docstring", F.lit("docstring")),
        rows(supplier.filter("s_acctbal > 0"), s_id, "decorator", F.lit("@solvent")),
        rows(places, s_id, "parent_class", F.col("n_name")),
        rows(places, s_id, "parent_class", F.col("r_name")),
    ]
    values = reduce(DataFrame.unionByName, values)
    keys = [
        values.filter("kind in ('decorator', 'calls') and entity_id like 'seg/%'").select("entity_id", "kind").distinct(),
        customer.select(c_id.alias("entity_id"), F.lit("has_docstring").alias("kind")),
        supplier.select(s_id.alias("entity_id"), F.lit("decorator").alias("kind")),
        supplier.select(s_id.alias("entity_id"), F.lit("parent_class").alias("kind")),
    ]
    return Corpus(entities, reduce(DataFrame.unionByName, keys), values)


#: The same corpus for the oracle: ``ent``, ``feats``, ``vals``.
MARKET_SQL = """
cu AS (SELECT 'seg/' || c_mktsegment || '/c.tbl' AS p, 'seg/' || c_mktsegment || '/c.tbl::c' || c_custkey AS id, * FROM customer),
su AS (SELECT 'sup/n' || s_nationkey || '/s.tbl' AS p, 'sup/n' || s_nationkey || '/s.tbl::S' || s_suppkey AS id, *
       FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
ent AS (SELECT id AS entity_id, 'function' AS kind, id AS qualified_name, p AS file_path, 1 AS line, c_custkey AS ordinal FROM cu
        UNION ALL SELECT id, 'class', id, p, 1, s_suppkey FROM su),
vals AS (SELECT DISTINCT id AS entity_id, 'decorator' AS kind, '@' || o_orderpriority AS value FROM cu JOIN orders ON o_custkey = c_custkey
         UNION ALL SELECT DISTINCT id, 'calls', o_orderstatus FROM cu JOIN orders ON o_custkey = c_custkey
         UNION ALL SELECT id, 'has_docstring', 'docstring' FROM cu WHERE c_acctbal > 0
         UNION ALL SELECT id, 'decorator', '@solvent' FROM su WHERE s_acctbal > 0
         UNION ALL SELECT id, 'parent_class', n_name FROM su UNION ALL SELECT id, 'parent_class', r_name FROM su),
feats AS (SELECT DISTINCT entity_id, kind FROM vals WHERE kind IN ('decorator', 'calls') AND entity_id LIKE 'seg/%'
          UNION ALL SELECT id, 'has_docstring' FROM cu UNION ALL SELECT id, 'decorator' FROM su UNION ALL SELECT id, 'parent_class' FROM su)
"""


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file a customer, a function for each order priority it used."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority").distinct()
    return entity(rows, "function", _text("cust/", "$o_custkey", ".tbl"), F.col("o_orderpriority"), F.lit(0))


BASKETS_SQL = """
ent AS (SELECT DISTINCT 'cust/' || o_custkey || '.tbl::' || o_orderpriority AS entity_id, 'file' AS scope,
               'cust/' || o_custkey || '.tbl' AS scope_id, o_orderpriority AS name FROM orders)
"""


def dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class a conversation, a method for each role in it."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "role").distinct()
    return entity(rows, "method", _text("conv/", "$conv_id", ".txt"), _text("Talk.", "$role"), F.lit(0))


DIALOGUES_SQL = """
talk AS (SELECT DISTINCT 'conv/' || conv_id || '.txt' AS p, role AS name FROM conversations),
ent AS (SELECT p || '::Talk.' || name AS entity_id, 'class' AS scope, p || '::Talk' AS scope_id, name FROM talk
        UNION ALL SELECT p || '::Talk.' || name, 'file', p, name FROM talk)
"""


def line_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory an order, a numbered file for each line."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    number = F.lpad(F.col("l_linenumber").cast("string"), 4, "0")
    path = F.concat(_text("ord/", "$l_orderkey", "/"), number, _text("_", "$l_partkey", "_", "$l_suppkey", ".tbl"))
    return entity(rows, "function", path, F.lit("f"), F.lit(0))


def lettered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    path = F.concat(_text("ord/", "$l_orderkey", "/part_"), F.char(F.col("l_linenumber") + 96), F.lit(".tbl"))
    return entity(rows, "function", path, F.lit("f"), F.lit(0))


def version_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return entity(rows, "function", _text("ord/", "$l_orderkey", "/lot_v", "$l_linenumber", "/x.tbl"), F.lit("f"), F.lit(0))


#: Distinct (order, number, rest) rows, holes and supports between neighbours.
HOLES_SQL = """
s AS (SELECT *, n - lag(n) OVER (PARTITION BY k ORDER BY n, path) AS step, count(*) OVER (PARTITION BY k) AS in_key FROM m),
i AS (SELECT *, sum(CASE WHEN step > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY n, path ROWS UNBOUNDED PRECEDING) AS island
      FROM s WHERE in_key >= 3),
c AS (SELECT k, island, count(*) AS support_n, min(n) AS lo, max(n) AS hi FROM i GROUP BY k, island HAVING count(*) >= 3),
e AS (SELECT k, island, support_n, hi - lo + 1 AS support_total, unnest(generate_series(lo, hi)) AS missing FROM c),
h AS (SELECT e.* FROM e WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.k = e.k AND i.island = e.island AND i.n = e.missing)),
a AS (SELECT h.k, h.missing, h.support_n, h.support_total, max(i.n * 1000000000000 + i.tie) AS top FROM h
      JOIN i ON i.k = h.k AND i.island = h.island AND i.n < h.missing GROUP BY 1, 2, 3, 4),
hole AS (SELECT a.k, a.missing, a.support_n, a.support_total, i.path AS anchor FROM a
         JOIN i ON i.k = a.k AND i.n * 1000000000000 + i.tie = a.top)
"""


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class for each user and day, a method for each type of event."""
    rows = table(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyyMMdd").alias("day"), "event_type").distinct()
    path, name = _text("ev/u", "$user_id", ".log"), _text("D", "$day")
    classes = entity(rows.select("user_id", "day").distinct(), "class", path, name, F.lit(0))
    return classes.unionByName(entity(rows, "method", path, F.concat(name, F.lit("."), F.col("event_type")), F.lit(1)))


VISIT_ALPHABET = [("funnel", [["signup", "login"], ["view", "click"], ["purchase"]], [])]


def papers(spark: SparkSession, sf_dir: str) -> Corpus:
    """Documents as classes, labels as functions that call the document they are about."""
    document, label = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    classes = entity(document, "class", _text("docs/d", "$doc_id", ".tbl"), _text("Doc", "$doc_id"), F.lit(0))
    values = label.select(_text("l", "$doc_id").alias("entity_id"), F.lit("calls").alias("kind"), _text("store.Doc", "$doc_id").alias("value"))
    return Corpus(classes, values.select("entity_id", "kind").distinct(), values.distinct())


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as functions of source files; finished ones have a test beside their file's mirror."""
    orders = table(spark, sf_dir, "orders")
    place = F.concat(F.lit("d"), (F.col("o_custkey") % 50).cast("string"), F.lit("/"))
    file = F.concat(F.lit("m"), (F.col("o_orderkey") % 40).cast("string"), F.lit(".py"))
    name = _text("f", "$o_orderkey")
    code = entity(orders, "function", F.concat(F.lit("src/"), place, file), name, F.col("o_orderkey"))
    done = orders.filter("o_orderstatus = 'F'")
    tests = entity(done, "function", F.concat(F.lit("tests/"), place, F.lit("test_"), file), F.concat(F.lit("test_"), name), F.col("o_orderkey"))
    return code.unionByName(tests)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page urls as paths without their scheme."""
    path = F.regexp_replace(F.col("url"), "^[a-z]+://", "")
    rows = table(spark, sf_dir, "pages").select("page_id", path.alias("path"), F.length("html").cast("long").alias("length"))
    return rows


def day_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's events as a run record."""
    e = table(spark, sf_dir, "events")
    day = F.date_trunc("day", F.col("ts")).cast("timestamp")
    rows = e.groupBy(day.alias("ts")).agg(
        F.count("*").alias("bytes"), F.sum(F.when(F.col("event_type") == "click", 1.0).otherwise(0.0)).alias("mine_ms"),
        F.count_if(F.col("event_type") == "view").cast("double").alias("finalize_ms"),
    )
    number = F.dayofmonth("ts")
    return rows.select(
        F.date_format("ts", "yyyyMMdd").alias("run_id"), "ts", F.when(number % 7 == 0, 4).otherwise(8).alias("cores"),
        F.when(number % 5 == 0, "0.9").otherwise("1.0").alias("version"), F.concat(F.lit("r"), (number % 3).cast("string")).alias("root"),
        "bytes", "mine_ms", "finalize_ms",
    )


DAY_RUNS_SQL = """
runs AS (SELECT strftime(d, '%Y%m%d') AS run_id, d AS ts, CASE WHEN day(d) % 7 = 0 THEN 4 ELSE 8 END AS cores,
         CASE WHEN day(d) % 5 = 0 THEN '0.9' ELSE '1.0' END AS version, 'r' || (day(d) % 3) AS root, bytes, mine_ms, finalize_ms
  FROM (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS d, count(*) AS bytes,
               sum(CASE WHEN event_type = 'click' THEN 1.0::DOUBLE ELSE 0 END) AS mine_ms,
               CAST(count(*) FILTER (event_type = 'view') AS DOUBLE) AS finalize_ms FROM events GROUP BY 1))
"""


def lines(spark: SparkSession, sf_dir: str) -> Corpus:
    """Order lines as functions in the directory of the month they were shipped in."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = table(spark, sf_dir, "lineitem").dropDuplicates(keys)
    path = F.concat(F.lit("ship/"), F.date_format("l_shipdate", "yyyyMM"), F.lit("/l.tbl"))
    name = F.concat_ws("_", *[F.col(k).cast("string") for k in keys])
    rows = rows.select(
        F.concat(path, F.lit("::"), name).alias("entity_id"), path.alias("file_path"), F.col("l_orderkey").alias("ordinal"),
        "l_returnflag", "l_linestatus", "l_tax", "l_discount", "l_quantity",
    )
    entities = rows.select(
        "entity_id", F.lit("function").alias("kind"), F.col("entity_id").alias("qualified_name"), "file_path", F.lit(1).alias("line"), "ordinal"
    )
    # one pass over the lines makes all their values
    found = F.array(
        F.struct(F.lit("decorator").alias("kind"), F.concat(F.lit("@"), F.col("l_returnflag")).alias("value")),
        F.struct(F.lit("calls").alias("kind"), F.col("l_linestatus").alias("value")),
        F.struct(F.lit("calls").alias("kind"), F.when(F.col("l_tax") > 0, "tax").alias("value")),
        F.struct(F.lit("calls").alias("kind"), F.when(F.col("l_discount") > 0.01, "discount").alias("value")),
        F.struct(F.lit("has_docstring").alias("kind"), F.when(F.col("l_quantity") > 5, "docstring").alias("value")),
    )
    values = rows.select("entity_id", F.inline(found)).filter("value is not null")
    kinds = F.explode(F.array(*[F.lit(k) for k in ("decorator", "calls", "has_docstring")])).alias("kind")
    return Corpus(entities, rows.select("entity_id", kinds), values)


LINES_SQL = """
li AS (SELECT DISTINCT ON (l_orderkey, l_linenumber, l_partkey, l_suppkey) *, 'ship/' || strftime(l_shipdate, '%Y%m') || '/l.tbl' AS p,
       'ship/' || strftime(l_shipdate, '%Y%m') || '/l.tbl::' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS id FROM lineitem),
ent AS (SELECT id AS entity_id, 'function' AS kind, id AS qualified_name, p AS file_path, 1 AS line, l_orderkey AS ordinal FROM li),
vals AS (SELECT id AS entity_id, 'decorator' AS kind, '@' || l_returnflag AS value FROM li UNION ALL SELECT id, 'calls', l_linestatus FROM li
  UNION ALL SELECT id, 'calls', 'tax' FROM li WHERE l_tax > 0 UNION ALL SELECT id, 'calls', 'discount' FROM li WHERE l_discount > 0.01
  UNION ALL SELECT id, 'has_docstring', 'docstring' FROM li WHERE l_quantity > 5),
feats AS (SELECT id AS entity_id, unnest(['decorator', 'calls', 'has_docstring']) AS kind FROM li)
"""
