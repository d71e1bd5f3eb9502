"""The subpackage's queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, decontaminate, licenses, line_dedup, packing, simhash, suffix_dedup, token_counts, token_files, toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.op1(_documents(spark, sf_dir))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op3(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.op4(_documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op5(_documents(spark, sf_dir))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op6(_documents(spark, sf_dir))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op7(_documents(spark, sf_dir))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.op8(_documents(spark, sf_dir))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.op9(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op10(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_suffix_dedup,
        op2_line_dedup,
        op3_toxicity,
        op4_token_counts,
        op5_packing,
        op6_simhash,
        op7_licenses,
        op8_token_files,
        op9_nearest,
        op10_decontaminate,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": line_dedup.ORACLE,
    "op10_decontaminate": decontaminate.ORACLE,
}
