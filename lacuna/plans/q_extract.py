"""Extraction, on sources written out of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import udfs
from ..sources import extract, state
from . import bindings as b
from .book import Book

BOOK = Book()


@BOOK.add("sca1_clean_calls", "SELECT p_partkey, 'f(...).g(' || p_size || ')' AS call FROM part")
def sca1(spark, sf_dir):
    text = F.concat(F.lit("f("), F.col("p_name"), F.lit("(x, (y))).g("), F.col("p_size").cast("string"), F.lit(")"))
    return b.table(spark, sf_dir, "part").select("p_partkey", udfs.clean_call_names(text).alias("call"))


def _written(spark, sf_dir, suffix: str, language: str, head: str, line: F.Column):
    """A file a nation, a definition a supplier, in the order of their keys."""
    rows = b.table(spark, sf_dir, "supplier").select("s_nationkey", F.struct("s_suppkey", line.alias("line")).alias("x"))
    files = rows.groupBy("s_nationkey").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    body = F.concat(F.lit(head), F.array_join(F.transform("xs", lambda x: x["line"]), ""))
    path = F.concat(F.lit("src/n"), F.col("s_nationkey").cast("string"), F.lit(suffix))
    return files.select(path.alias("path"), F.lit(language).alias("language"), F.encode(body, "UTF-8").alias("content"))


def _found(files):
    rows = state.last_definitions(extract.Registry().extract(files))
    calls = F.array_join(F.array_sort(F.coalesce(F.col("features")["calls"], F.array())), ",")
    return rows.select("entity_id", "kind", "line", calls.alias("calls"))


_NTH = "(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey))"


@BOOK.add(
    "ext1_python",
    f"""SELECT 'src/n' || s_nationkey || '.py::s' || s_suppkey AS entity_id, 'function' AS kind, CAST(3 * {_NTH} - 1 AS INTEGER) AS line,
  CASE WHEN s_acctbal > 0 THEN 'bank.rate,bank.rate(...).top,check' ELSE 'check' END AS calls FROM supplier
UNION ALL SELECT DISTINCT 'src/n' || s_nationkey || '.py::__module__', 'module', 1, '' FROM supplier""",
)
def ext1(spark, sf_dir):
    rich = F.when(F.col("s_acctbal") > 0, "bank.rate(1, (2)).top(x)").otherwise("x")
    key = F.col("s_suppkey").cast("string")
    line = F.concat(F.lit("@audit(1)\ndef s"), key, F.lit("(x):\n    return check("), rich, F.lit(")\n"))
    return _found(_written(spark, sf_dir, ".py", "python", "", line))


@BOOK.add(
    "ext6_go",
    f"""SELECT 'src/n' || s_nationkey || '.go::' || CASE WHEN s_acctbal > 0 THEN 'Bank.' ELSE '' END || 's' || s_suppkey AS entity_id,
  CASE WHEN s_acctbal > 0 THEN 'method' ELSE 'function' END AS kind, CAST(1 + {_NTH} AS INTEGER) AS line, 'fmt.Sprint,help' AS calls FROM supplier""",
)
def ext6(spark, sf_dir):
    receiver = F.when(F.col("s_acctbal") > 0, "(b *Bank) ").otherwise("")
    key = F.col("s_suppkey").cast("string")
    line = F.concat(F.lit("func "), receiver, F.lit("s"), key, F.lit('() { help(fmt.Sprint("no()")) } // not()\n'))
    return _found(_written(spark, sf_dir, ".go", "go", "package main\n", line))


@BOOK.add(
    "src4_languages",
    """SELECT p_partkey, CASE WHEN p_type LIKE '%STEEL%' THEN 'python' WHEN p_type LIKE '%BRASS%' THEN 'cpp' ELSE 'bash' END AS language
FROM part WHERE p_size > 5""",
)
def src4(spark, sf_dir):
    kind = F.col("p_type")
    ending = F.when(F.col("p_size") <= 5, ".txt").when(kind.contains("STEEL"), ".PY").when(kind.contains("BRASS"), ".h.hpp").otherwise(".sh")
    rows = b.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("a.b/c"), ending).alias("path"))
    return extract.Registry().with_language(rows).select("p_partkey", "language")


#: Of each language a file's head, what is written for a supplier with and without money
#: ({k} is its key), and the entities in it: kind, name, line, decorators, supertypes, calls.
SNIPPETS = {
    "ext2_javascript": (
        ".js", "javascript", "import x from 'y';\n",
        "class S{k} extends Base { pay(a) { this.log(a); } }\n",
        [("class", "S{k}", 0, "", "Base", ""), ("method", "S{k}.pay", 0, "", "", "this.log")],
        "export async function s{k}(a) { check(rate.of(a), 'no()'); } // no()\n",
        [("function", "s{k}", 0, "", "", "check,rate.of")],
    ),
    "ext3_typescript": (
        ".ts", "typescript", "",
        "@Injectable() export class S{k} extends Base implements One, Two<X> { @Get() pay(a: number): void { this.log(a); } }\n",
        [("class", "S{k}", 0, "@Injectable", "Base,One,Two", ""), ("method", "S{k}.pay", 0, "@Get", "", "this.log")],
        "export function s{k}(a: number): number { return check(a); } // no()\n",
        [("function", "s{k}", 0, "", "", "check")],
    ),
    "ext4_tsx": (
        ".tsx", "tsx", "",
        "interface S{k} extends Base { a: string }\n",
        [("interface", "S{k}", 0, "", "Base", "")],
        "export const s{k} = (a: number) => { return check(a, `no()`); };\n",
        [("function", "s{k}", 0, "", "", "check")],
    ),
    "ext5_rust": (
        ".rs", "rust", "use x;\n",
        "#[derive(Debug)] pub struct S{k} { a: String }\n",
        [("struct", "S{k}", 0, "#[derive]", "", "")],
        "pub fn s{k}() { println!(\"no()\"); other::go(); } // no()\n",
        [("function", "s{k}", 0, "", "", "other::go,println!")],
    ),
    "ext7_java": (
        ".java", "java", "package a;\n",
        "@Service public class S{k} extends Base implements One { @Override public int pay(int x) { return db.find(new Thing(x)); } }\n",
        [("class", "S{k}", 0, "@Service", "Base,One", ""), ("method", "S{k}.pay", 0, "@Override", "", "db.find,new Thing")],
        "interface T{k} extends Base {} // no()\n",
        [("interface", "T{k}", 0, "", "Base", "")],
    ),
    "ext8_ruby": (
        ".rb", "ruby", "require 'x'\n",
        "class S{k} < Base\n  def pay(x)\n    helper.log(x)\n  end\nend\n",
        [("class", "S{k}", 0, "", "Base", ""), ("method", "S{k}.pay", 1, "", "", "helper.log")],
        "def s{k}(x)\n  check(x)\nend\n# no()\n\n",
        [("function", "s{k}", 0, "", "", "check")],
    ),
    "ext9_csharp": (
        ".cs", "csharp", "using X;\n",
        "[Serializable] public class S{k} : Base, IOne { [HttpGet] public int Pay(int x) { return svc.Find(x); } }\n",
        [("class", "S{k}", 0, "[Serializable]", "Base,IOne", ""), ("method", "S{k}.Pay", 0, "[HttpGet]", "", "svc.Find")],
        "public struct T{k} { } // no()\n",
        [("struct", "T{k}", 0, "", "", "")],
    ),
    "ext10_swift": (
        ".swift", "swift", "import X\n",
        "class S{k}: Base, One { func pay(a: Int) { log(a) } }\n",
        [("class", "S{k}", 0, "", "Base,One", ""), ("method", "S{k}.pay", 0, "", "", "log")],
        "func s{k}(a: Int) { check(a) } // no()\n",
        [("function", "s{k}", 0, "", "", "check")],
    ),
    "ext11_c": (
        ".c", "c", "#include <x.h>\n",
        "struct S{k} { int a; };\n",
        [("struct", "S{k}", 0, "", "", "")],
        "static int s{k}(int a) { if (a) return check(a, \"no()\"); return 0; } /* no() */\n",
        [("function", "s{k}", 0, "", "", "check")],
    ),
    "ext12_cpp": (
        ".cpp", "cpp", "#include <x>\n",
        "class S{k} : public Base, private Other { int pay() const { return h::log(); } };\n",
        [("class", "S{k}", 0, "", "Base,Other", ""), ("method", "S{k}.pay", 0, "", "", "h::log")],
        "int s{k}(int a) { return check(a); } // no()\n",
        [("function", "s{k}", 0, "", "", "check")],
    ),
    "ext13_php": (
        ".php", "php", "<?php\n",
        "class S{k} extends Base implements One { public function pay($a) { Foo::bar($a); new Thing(); } }\n",
        [("class", "S{k}", 0, "", "Base,One", ""), ("method", "S{k}.pay", 0, "", "", "Foo.bar,new Thing")],
        "function s{k}($a) { check($a); } # no()\n",
        [("function", "s{k}", 0, "", "", "check")],
    ),
    "ext14_kotlin": (
        ".kt", "kotlin", "package a\n",
        "@Service class S{k}(val x: Int) : Base(x), One { fun pay(a: Int) { api.log(a) } }\n",
        [("class", "S{k}", 0, "@Service", "Base,One", ""), ("method", "S{k}.pay", 0, "", "", "api.log")],
        "fun s{k}(a: Int) { check(a) } // no()\n",
        [("function", "s{k}", 0, "", "", "check")],
    ),
    "ext15_scala": (
        ".scala", "scala", "package a\n",
        "class S{k}(x: Int) extends Base(x) with One { def pay(a: Int) = { api.log(a) } }\n",
        [("class", "S{k}", 0, "", "Base,One", ""), ("method", "S{k}.pay", 0, "", "", "api.log")],
        "trait T{k} { } // no()\n",
        [("trait", "T{k}", 0, "", "", "")],
    ),
    "ext16_lua": (
        ".lua", "lua", "local M = {}\n",
        "function S{k}:pay(a) log(a) end\n",
        [("method", "S{k}.pay", 0, "", "", "log")],
        "function s{k}(a) if a then check(a) end end -- no()\n",
        [("function", "s{k}", 0, "", "", "check")],
    ),
    "ext17_bash": (
        ".sh", "bash", "#!/bin/bash\n",
        "function S{k} { log x | tee y; }\n",
        [("function", "S{k}", 0, "", "", "log,tee")],
        "s{k}() { if check \"no\"; then echo hi; fi; } # no\n",
        [("function", "s{k}", 0, "", "", "check,echo")],
    ),
}


def _snippet_sql(suffix: str, head: str, rich: str, rich_rows: list, plain: str, plain_rows: list) -> str:
    """One row an entity, in plain SQL over the suppliers."""
    assert rich.count("\n") == plain.count("\n")
    parts = []
    for test, rows in (("s_acctbal > 0", rich_rows), ("NOT s_acctbal > 0", plain_rows)):
        for kind, name, at, decorators, parents, calls in rows:
            named = name.replace("{k}", "' || s_suppkey || '")
            parts.append(
                f"SELECT 'src/n' || s_nationkey || '{suffix}::{named}' AS entity_id, '{kind}' AS kind, "
                f"CAST({head.count(chr(10)) + 1 + at} + {rich.count(chr(10))} * (nth - 1) AS INTEGER) AS line, "
                f"'{decorators}' AS decorators, '{parents}' AS parents, '{calls}' AS calls FROM s WHERE {test}"
            )
    return f"WITH s AS (SELECT *, {_NTH} AS nth FROM supplier) " + " UNION ALL ".join(parts)


def _snippet(suffix: str, language: str, head: str, rich: str, plain: str):
    def query(spark, sf_dir):
        key = F.col("s_suppkey").cast("string")
        line = F.when(F.col("s_acctbal") > 0, F.replace(F.lit(rich), F.lit("{k}"), key)).otherwise(F.replace(F.lit(plain), F.lit("{k}"), key))
        rows = state.last_definitions(extract.Registry().extract(_written(spark, sf_dir, suffix, language, head, line)))
        joined = [F.array_join(F.array_sort(F.coalesce(F.col("features")[k], F.array())), ",").alias(n) for k, n in _LISTS]
        return rows.select("entity_id", "kind", "line", *joined)

    return query


_LISTS = [("decorator", "decorators"), ("parent_class", "parents"), ("calls", "calls")]
for _name, (_suffix, _language, _head, _rich, _rich_rows, _plain, _plain_rows) in SNIPPETS.items():
    BOOK.add(_name, _snippet_sql(_suffix, _head, _rich, _rich_rows, _plain, _plain_rows))(_snippet(_suffix, _language, _head, _rich, _plain))
