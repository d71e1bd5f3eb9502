"""Corpus pipeline: toxicity, line dedup, near-duplicates, decontamination, packing.

Each stage is written as Parquet and read again as the next one's documents.  The
first four return the columns of ``documents``; the last returns packed pieces.
SQL can't express the trained first stage, so ``ORACLE_SQL`` is None and the tests
hold every stage against a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import decontaminate, line_dedup, packing, similar, toxicity
from lacuna.llm.common import cut

#: Documents that score this or more are rejected.
TOXIC = toxicity.THRESHOLD


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on all labels, does not call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(toxicity.sample(docs, labels, held_out=None))
    return toxicity.toxicity(docs, model, rest=True).filter(F.col("score") < TOXIC).select("rest.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of three-line windows; ``n_chars`` follows the text, null text is empty."""
    left = line_dedup.line_dedup(docs, rest=True)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return left.select(*[new[c].alias(c) if c in new else F.col(f"rest.`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a five-word similarity of 0.8 or more."""
    return similar.without_similar(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with their sequences."""
    return packing.op5(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash", drop_near_duplicates),
    ("decontaminate", drop_leaks),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
