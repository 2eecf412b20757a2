"""The registered queries of the corpus operators, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import (
    chunk_reuse,
    decontaminate,
    exact_dedup,
    filter_audit,
    hard_negatives,
    language_mixture,
    mixture,
    quality,
    simhash,
    span_dedup,
    token_output,
    toxicity,
    url_filter,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_mixture.identify(_documents(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op4_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_dedup.removals(_documents(spark, sf_dir))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.round_trip(_documents(spark, sf_dir))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(_documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_documents(spark, sf_dir))


def op11_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_reuse.digests(_documents(spark, sf_dir))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives.hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_documents(spark, sf_dir), _labels(spark, sf_dir))


for _query in (
    op1_simhash, op2_language_id, op3_quality, op4_span_dedup, op5_url_filter, op6_token_output, op7_decontamination, op8_mixing, op9_toxicity, op10_exact_dedup,
    op11_chunk_bpe, op12_hard_negatives, op13_filter_audit,
):
    QUERIES[_query.__name__] = _query
ORACLE["op12_hard_negatives"] = hard_negatives.ORACLE
ORACLE["op13_filter_audit"] = filter_audit.ORACLE
ORACLE["op10_exact_dedup"] = exact_dedup.ORACLE
ORACLE["op4_span_dedup"] = span_dedup.ORACLE
