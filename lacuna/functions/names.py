"""Scalar functions over identifiers and paths, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def short_id(full_id: Column | str) -> Column:
    """``g-`` and seven hex digits of the id's SHA-256."""
    return F.concat(F.lit("g-"), F.substring(F.sha2(col(full_id), 256), 1, 7))


def rule_id(group_id: Column | str, kind: Column | str, value: Column | str) -> Column:
    return F.concat(col(group_id), F.lit("::"), col(kind), F.lit("="), col(value))


def gap_id(rule: Column | str, entity: Column | str) -> Column:
    return F.concat(col(rule), F.lit("::"), col(entity))


def short_name(qualified: Column | str) -> Column:
    """What follows the last ``::`` and then the last dot."""
    return F.substring_index(F.substring_index(col(qualified), "::", -1), ".", -1)


def last_segment(qualified: Column | str) -> Column:
    return F.substring_index(col(qualified), "::", -1)


def bare_class_name(qualified: Column | str) -> Column:
    """``short_name``, but empty without any ``::``."""
    q = col(qualified)
    return F.when(F.instr(q, "::") > 0, short_name(q)).otherwise(F.lit(""))


def class_scope(kind: Column | str, qualified: Column | str) -> Column:
    """The class a method belongs to: all before the last dot after the first ``::``; else null."""
    q = col(qualified)
    owner = F.regexp_extract(q, r"(?s)^(.*?::.*)\.[^.]*$", 1)
    rest = F.regexp_extract(q, r"(?s)^.*?::(.*)$", 1)
    return F.when((col(kind) == "method") & (F.instr(rest, ".") > 0), owner)


def parent_directory(path: Column | str) -> Column:
    """Directory of a POSIX path; ``<root>`` at the top."""
    p = col(path)
    up = F.regexp_replace(p, r"/[^/]*$", "")
    return F.when(F.instr(p, "/") == 0, "<root>").when(up == "", "/").otherwise(up)


def directory(path: Column | str) -> Column:
    """All before the last slash; empty at the top."""
    p = col(path)
    return F.when(F.instr(p, "/") == 0, "").otherwise(F.regexp_replace(p, r"/[^/]*$", ""))


def basename(path: Column | str) -> Column:
    return F.substring_index(col(path), "/", -1)


def extension(path: Column | str) -> Column:
    """Lower-cased from the path's last dot; empty without one."""
    p = col(path)
    return F.lower(F.when(F.instr(p, ".") > 0, F.concat(F.lit("."), F.substring_index(p, ".", -1))).otherwise(""))


def leading_number(name: Column | str) -> Column:
    """Digits that a name begins with, up to 18 of them; null otherwise."""
    digits = F.regexp_extract(col(name), r"^([0-9]+)", 1)
    return F.when((digits != "") & (F.length(digits) <= 18), digits)


def zero_padded(number: Column, width: Column) -> Column:
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.length(text), width), F.lit("0"))


def reference_names(value: Column | str) -> Column:
    """A reference's full form, without one leading ``@``, and its last dotted part."""
    v = F.regexp_replace(col(value), "^@", "")
    return F.array_distinct(F.array(v, F.substring_index(v, ".", -1)))


def identifiers(text: Column | str) -> Column:
    """ASCII identifiers of a text, with repeats."""
    words = F.split(col(text), "[^A-Za-z0-9_]+")
    return F.filter(words, lambda w: w.rlike("^[A-Za-z_]"))


def stem(name: Column | str) -> Column:
    """A file name without what its last dot begins."""
    n = col(name)
    return F.when(F.instr(n, ".") > 0, F.regexp_replace(n, r"\.[^.]*$", "")).otherwise(n)


def suffix(name: Column | str) -> Column:
    n = col(name)
    return F.when(F.instr(n, ".") > 0, F.concat(F.lit("."), F.substring_index(n, ".", -1))).otherwise("")


#: Directories and name endings that mark tests.
TEST_DIRECTORIES = ["tests", "test", "__tests__", "spec"]
TEST_ENDINGS = ["_test.py", "_test.go", ".test.ts", ".test.tsx", ".test.js", ".spec.ts", ".spec.tsx", ".spec.js"]


def is_test_file(path: Column | str) -> Column:
    """In a test directory, or named like a test."""
    p = col(path)
    found = F.arrays_overlap(F.split(p, "/"), F.array(*[F.lit(x) for x in TEST_DIRECTORIES]))
    found = found | basename(p).startswith("test_")
    for ending in TEST_ENDINGS:
        found = found | basename(p).endswith(ending)
    return found


def candidate_test_files(path: Column | str) -> Column:
    """Where a source file's tests may lie: prefix and suffix names in up to four directories."""
    p = col(path)
    name, up = basename(p), directory(p)
    names = F.array(F.concat(F.lit("test_"), name), F.concat(stem(name), F.lit("_test"), suffix(name)))
    mirrored = F.when(up.rlike("^(src|lib|source)(/|$)"), F.regexp_replace(up, "^(src|lib|source)", "tests"))
    under = F.when(up != "", F.concat(F.lit("tests/"), up))
    folders = F.filter(F.array(mirrored, under, F.lit("tests"), up), lambda d: d.isNotNull())

    def both(d: Column) -> Column:
        return F.transform(names, lambda n: F.when(d == "", n).otherwise(F.concat(d, F.lit("/"), n)))

    return F.array_distinct(F.flatten(F.transform(folders, both)))


def confidence_tier(confidence: Column | str) -> Column:
    c = col(confidence)
    return F.when(c >= 0.95, "high").when(c >= 0.80, "medium").otherwise("low")


def sarif_level(confidence: Column | str) -> Column:
    return F.when(col(confidence) >= 0.9, "warning").otherwise("note")


def human_size(n: Column | str) -> Column:
    b = col(n).cast("double")
    return (
        F.when(b < 1024, F.format_string("%d B", col(n).cast("long")))
        .when(b < 1024**2, F.format_string("%.1f KB", F.bround(b / 1024, 1)))
        .when(b < 1024**3, F.format_string("%.1f MB", F.bround(b / 1024**2, 1)))
        .otherwise(F.format_string("%.1f GB", F.bround(b / 1024**3, 1)))
    )


def human_seconds(n: Column | str, hours: bool = True) -> Column:
    """Seconds as ``45.2 s``, ``3 m 12 s`` or ``1 h 4 m``; without ``hours`` the last as ``64 m 10 s``."""
    s = col(n).cast("double")
    whole_m, whole_h = F.floor(s / 60), F.floor(s / 3600)
    seconds = F.format_string("%.1f s", F.bround(s, 1))
    minutes = F.format_string("%d m %2d s", whole_m, F.floor(s - whole_m * 60))
    if not hours:
        return F.when(s < 60, seconds).otherwise(minutes)
    return F.when(s < 60, seconds).when(s < 3600, minutes).otherwise(F.format_string("%d h %d m", whole_h, F.floor((s - whole_h * 3600) / 60)))


def age_days(then: Column, now: Column) -> Column:
    """Whole days between two timestamps, never negative; null if either is unknown."""
    seconds = F.unix_timestamp(now) - F.unix_timestamp(then)
    return F.greatest(F.lit(0), F.floor(seconds / 86400)).cast("int")
