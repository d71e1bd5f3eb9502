from pathlib import Path

from helpers import compare
from pyspark.sql import functions as F

from lacuna.functions import names
from lacuna.plans import registry


def test_report_past_an_hour(spark, sf_dir, tmp_path):
    """Pages whose serial time is some two hours; the SQL shows it in minutes."""
    for t in Path(sf_dir).glob("*.parquet"):
        if t.stem != "pages":
            (tmp_path / t.name).symlink_to(t)
    url = F.format_string("https://x.org/%s/%d", F.when(F.col("id") % 3 == 0, "fr").otherwise("en"), F.col("id"))
    pages = spark.range(3000).select(F.col("id").alias("page_id"), url.alias("url"), F.repeat(F.lit("x"), F.lit(30_000)).alias("html"))
    pages.toPandas().to_parquet(tmp_path / "pages.parquet")
    assert compare(spark, str(tmp_path), "est11_report", registry.QUERIES["est11_report"], registry.ORACLE_SQL["est11_report"]) == 5


def test_seconds_without_hours(spark):
    rows = spark.createDataFrame([(45.23,), (192.9,), (3860.0,)], "s double")
    assert [r[0] for r in rows.select(names.human_seconds("s", hours=False)).collect()] == ["45.2 s", "3 m 12 s", "64 m 20 s"]
    assert [r[0] for r in rows.select(names.human_seconds("s")).collect()] == ["45.2 s", "3 m 12 s", "1 h 4 m"]
