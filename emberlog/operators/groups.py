"""Error events to failure groups.

``counts.count_patterns`` is the only pass over the records: it cuts them down to one row per scope, pattern, level, service and
source type and task, so a pattern that holds most of the records ships one row per task. Everything else (groups, ranks,
examples, insights, summary) is computed from these few rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.levels import severity_rank
from emberlog.functions.patterns import is_error_event, write_normalized
from emberlog.functions.plan import Steps, add, replay
from emberlog.functions.text import null_if_empty
from emberlog.operators.counts import EXAMPLES_KEPT, KEYS


def with_pattern(parsed: DataFrame) -> DataFrame:
    """Add ``is_error`` and ``pattern``; only error events pay the masking regexes, others have no pattern."""
    return replay(parsed, _write_pattern).drop("__normal", "__low", "__has_digit")


def _write_pattern(steps: Steps) -> None:
    add(steps, "is_error", F.coalesce(is_error_event(F.col("level"), F.col("message")), F.lit(False)))
    write_normalized(steps, "__normal", F.when(F.col("is_error"), F.col("message")))
    normal = F.col("__normal")
    add(steps, "pattern", F.when(normal != "", normal).when(F.col("is_error"), F.col("message")))


def error_events(parsed: DataFrame) -> DataFrame:
    return parsed.where(is_error_event(F.col("level"), F.col("message")))


def pattern_stats(counted: DataFrame) -> DataFrame:
    """The rows of ``counts.count_patterns`` added up to one per combination."""
    return counted.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("n_lines").alias("n_lines"), F.min("first_pos").alias("first_pos"))


def error_groups(stats: DataFrame) -> DataFrame:
    """One row per scope and case-folded pattern: count, first spelling, highest level, common service and source."""
    first = F.col("first_pos")
    service = null_if_empty(F.col("service"))
    grouped = (
        stats.where("is_error")
        .groupBy("scope", F.lower("pattern").alias("pattern_key"))
        .agg(
            F.sum("n").alias("count"),
            F.min_by("pattern", first).alias("pattern"),
            F.min_by("level", F.struct(-severity_rank(F.col("level")), first)).alias("level"),
            F.min(service).alias("__service_min"),
            F.max(service).alias("__service_max"),
            F.min("source_type").alias("__source_min"),
            F.max("source_type").alias("__source_max"),
        )
    )

    def common(name):
        low, high = F.col(f"__{name}_min"), F.col(f"__{name}_max")
        return F.when(low == high, low).when(low.isNotNull(), "multiple")

    return grouped.select(
        "scope", "pattern_key", "pattern", "count", "level",
        common("service").alias("service"), common("source").alias("source_type"),
    )


def ranked(groups: DataFrame, limit: int | None) -> DataFrame:
    """Rank by count, then by case-folded pattern. With a limit no task sees more than ``limit`` rows per scope and input task."""
    order = Window.partitionBy("scope").orderBy(F.desc("count"), F.asc("pattern_key"))
    out = groups.withColumn("rank", F.row_number().over(order))
    return out if limit is None else out.where(F.col("rank") <= limit)


def group_examples(counted: DataFrame) -> DataFrame:
    """The first three records of each group, from the rows of ``counts.count_patterns``; a task ships at most three per group."""
    order = Window.partitionBy("scope", "pattern_key").orderBy("pos")
    return (
        counted.where("is_error")
        .select("scope", F.lower("pattern").alias("pattern_key"), F.explode("examples").alias("e"))
        .select("scope", "pattern_key", "e.pos", "e.raw")
        .withColumn("__n", F.row_number().over(order))
        .where(F.col("__n") <= EXAMPLES_KEPT)
        .groupBy("scope", "pattern_key")
        .agg(F.array_sort(F.collect_list(F.struct("__n", "raw")))["raw"].alias("examples"))
    )


def with_examples(groups: DataFrame, examples: DataFrame) -> DataFrame:
    """Groups with their examples; the top groups, a bounded few per scope, decide which are wanted."""
    named = examples.select(F.col("scope").alias("__scope"), F.col("pattern_key").alias("__key"), "examples")
    return groups.join(named, F.col("scope").eqNullSafe(F.col("__scope")) & (F.col("pattern_key") == F.col("__key")), "left").drop("__scope", "__key")


def breakdown(counts: DataFrame, name: str) -> DataFrame:
    """``scope, rank, <name>, n`` in display order, the largest first, equal ones by name; for source types and categories.

    There are a few dozen names, so a scope's ranking is small work.
    """
    order = Window.partitionBy("scope").orderBy(F.desc("n"), name)
    return counts.select("scope", F.row_number().over(order).alias("rank"), name, "n")


def source_counts(stats: DataFrame) -> DataFrame:
    """Records per source type."""
    return stats.groupBy("scope", "source_type").agg(F.sum("n").alias("n"))
