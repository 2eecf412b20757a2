"""Totals and the dominant issue of each scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def percentage(part: Column, whole: Column) -> Column:
    """Share in percent with one decimal. Exact halves (multiples of a quarter) go to the even digit."""
    share = part / whole * 100
    return F.when(share * 4 == F.floor(share * 4), F.bround(share, 1)).otherwise(F.round(share, 1))


def summary(stats: DataFrame) -> DataFrame:
    """One row per scope, from the pattern counts in one chain of aggregates (no join, no second pass)."""
    patterns = stats.groupBy("scope", "is_error", F.lower("pattern").alias("pattern_key")).agg(
        F.sum("n").alias("n"), F.sum("n_lines").alias("n_lines"), F.min_by("pattern", "first_pos").alias("pattern")
    )
    error = F.col("is_error")
    order = F.struct((-F.col("n")).alias("c"), F.col("pattern_key"))
    totals = patterns.groupBy("scope").agg(
        F.sum("n_lines").alias("total_lines"),
        F.sum("n").alias("parsed_lines"),
        F.sum(F.when(error, F.col("n")).otherwise(0)).alias("error_events"),
        F.count_if(error).alias("unique_patterns"),
        F.min_by(F.col("pattern"), F.when(error, order)).alias("dominant_issue"),
        F.max(F.when(error, F.col("n"))).alias("__top"),
    )
    share = F.when(F.col("error_events") > 0, percentage(F.col("__top"), F.col("error_events")))
    return totals.select(
        "scope", "total_lines", "parsed_lines", "error_events", "unique_patterns", "dominant_issue",
        F.coalesce(share, F.lit(0.0)).alias("dominant_percentage"),
    )
