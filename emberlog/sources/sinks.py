"""Sinks: analysis results as tables, safe lines as text."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.plans.analyze import DEFAULT_GROUPS, Analysis, analyze
from emberlog.plans.sanitize import Sanitized
from emberlog.sources.rules import Rule

RESULTS = ("summary", "source_types", "groups", "insights")


def write_analysis(
    records: DataFrame,
    path: str,
    source_type: str = "auto",
    max_groups: int = DEFAULT_GROUPS,
    rules: list[Rule] | None = None,
) -> Analysis:
    """Analyse and write all results under ``path`` as Parquet. The records are read and parsed once for all of them."""
    result = analyze(records, source_type, max_groups, rules)
    for name in RESULTS:
        getattr(result, name).write.mode("overwrite").parquet(f"{path}/{name}")
    return result


def write_sanitized(result: Sanitized, path: str, report: str | None = None) -> None:
    """Write the safe lines as text in their order: part files follow each other, lines within a part too.

    With ``report`` the summary, the counts by category and the examples are written under it as Parquet; the lines are redacted once
    for all of it.
    """
    result = result.once() if report else result
    ordered = result.lines.select("scope", "pos", "sanitized").repartitionByRange("scope", "pos")
    ordered.sortWithinPartitions("scope", "pos").select("sanitized").write.mode("overwrite").text(path)
    for name in ("summary", "categories", "examples") if report else ():
        getattr(result, name).write.mode("overwrite").parquet(f"{report}/{name}")


def rejoined_text(sanitized_lines: DataFrame) -> DataFrame:
    """One text per scope with each line's own end; for tables read with ``table_lines(..., keep_ends=True)``.

    For scopes that were one cell of a table; a scope of any size goes through ``write_texts``.
    """
    pieces = F.array_sort(F.collect_list(F.struct("pos", F.concat("sanitized", "line_end").alias("t"))))
    return sanitized_lines.groupBy("scope").agg(F.array_join(F.transform(pieces, lambda p: p["t"]), "").alias("text"))


#: Characters of a part of a text, about.
PART_CHARS = 4 << 20
PARTS = "scope string, task int, seq long, chars long, n_bytes long, text string"


def _parts(part_chars: int):
    """Consecutive lines of a scope as parts of about ``part_chars`` characters; a part never mixes scopes."""

    def join(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        task, seq, held, size, of = TaskContext.get().partitionId(), 0, [], 0, None

        def part():
            text = "".join(held)
            values = (of, task, seq, len(text), len(text.encode()), text)
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["scope", "task", "seq", "chars", "n_bytes", "text"])

        for batch in batches:
            for scope, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (scope != of or size >= part_chars):
                    yield part()
                    seq, held, size = seq + 1, [], 0
                of, size = scope, size + len(piece)
                held.append(piece)
        if held:
            yield part()

    return join


def write_texts(sanitized_lines: DataFrame, path: str, part_chars: int = PART_CHARS) -> None:
    """Write each scope's text, of any size, as numbered parts: lines with their own ends, in order.

    ``sanitized_lines`` has ``scope, pos, sanitized`` and, if the ends are to be kept, ``line_end`` (else lines end in ``\\n``). Lines
    are dealt by ranges of their place, so a scope that holds all lines is spread over all tasks, and a task holds one part.
    """
    end = F.col("line_end") if "line_end" in sanitized_lines.columns else F.lit("\n")
    pieces = sanitized_lines.select("scope", "pos", F.concat("sanitized", end).alias("piece"))
    ordered = pieces.repartitionByRange("scope", "pos").sortWithinPartitions("scope", "pos").select("scope", "piece")
    ordered.mapInArrow(_parts(part_chars), PARTS).write.mode("overwrite").parquet(path)


def text_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``scope, part, offset, n_bytes, task, seq`` of the parts at ``path``: a scope's parts by number, with the byte each begins at.

    One short row a part; the texts are not read.
    """
    parts = spark.read.schema(PARTS).parquet(path).select("scope", "task", "seq", "n_bytes")
    order = Window.partitionBy("scope").orderBy("task", "seq")
    before = F.coalesce(F.sum("n_bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.select("scope", F.row_number().over(order).alias("part"), before.alias("offset"), "n_bytes", "task", "seq")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``scope, part, offset, text`` of the parts at ``path``."""
    texts = spark.read.schema(PARTS).parquet(path).select("scope", "task", "seq", "text")
    places = text_manifest(spark, path).select(*[F.col(c).alias(f"__{c}") for c in ("scope", "task", "seq")], "part", "offset")
    same = F.col("scope").eqNullSafe(F.col("__scope")) & (F.col("task") == F.col("__task")) & (F.col("seq") == F.col("__seq"))
    return texts.join(places, same).select("scope", "part", "offset", "text")
