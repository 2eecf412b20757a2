"""Sources of log text: files by extension, and tables with a text column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.text import LINE_END, split_lines, split_lines_with_ends

# Extensions taken as log files.
LOG_EXTENSIONS = ("log", "txt", "json", "jsonl", "out", "text")

#: Rows of a task of ``spread``: parsing or redacting a row takes up to some hundred microseconds.
ROWS_A_TASK = 50_000


def file_lines(spark: SparkSession, paths: str | Sequence[str], scope: str = "file") -> DataFrame:
    """``lines(scope, path, block, line)`` of log files under the paths, in scan order within each task.

    ``scope='file'`` makes each file a unit of its own; any other text is one scope name for all files.
    Large files are split by ``spark.sql.files.maxPartitionBytes``; ``block`` is the split's byte offset.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise ValueError("no input paths")
    raw = (
        spark.read.option("pathGlobFilter", "*.{" + ",".join(LOG_EXTENSIONS) + "}")
        .option("recursiveFileLookup", True)
        .text(paths)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.col("value"),
        )
    )
    pieces = F.when(F.col("value").rlike(LINE_END), F.split("value", LINE_END, -1)).otherwise(F.array("value"))
    scope_col = F.col("path") if scope == "file" else F.lit(scope)
    return raw.select(scope_col.alias("scope"), "path", "block", F.explode(pieces).alias("line"))


def positioned(lines: DataFrame) -> DataFrame:
    """``lines(scope, pos, line)`` of file lines, for operators that need no records."""
    pos = F.struct("path", "block", F.monotonically_increasing_id().alias("n"))
    return lines.select("scope", pos.alias("pos"), "line")


def table_lines(
    df: DataFrame, text: str, scope: str | Column, order: str | Column | None = None, keep_ends: bool = False
) -> DataFrame:
    """``lines(scope, pos, line)`` of a text column; ``order`` orders the rows of a scope.

    ``keep_ends`` adds ``line_end``, each line's own ending, so that the text can be put together again unchanged.
    """
    scope = F.col(scope) if isinstance(scope, str) else scope
    order = F.col(order) if isinstance(order, str) else order
    keep = [scope.cast("string").alias("scope")]
    if order is not None:
        keep.append(order.alias("__order"))
    pieces = split_lines_with_ends(F.col(text)) if keep_ends else split_lines(F.col(text))
    out = df.select(*keep, F.posexplode(pieces).alias("__n", "line"))
    number = F.col("__n").cast("bigint")
    pos = number if order is None else F.struct(F.col("__order").alias("row"), number.alias("n"))
    if not keep_ends:
        return out.select("scope", pos.alias("pos"), "line")
    content = F.regexp_replace("line", rf"(?:{LINE_END})\z", "")
    return out.select(
        "scope", pos.alias("pos"), content.alias("line"), F.col("line").substr(F.length(content) + 1, F.lit(2)).alias("line_end")
    )


def row_lines(df: DataFrame, line: str, scope: str | Column, order: str | Column) -> DataFrame:
    """``lines(scope, pos, line)`` of rows that hold one line each."""
    scope = F.col(scope) if isinstance(scope, str) else scope
    order = F.col(order) if isinstance(order, str) else order
    return df.select(scope.cast("string").alias("scope"), order.alias("pos"), F.col(line).alias("line"))


def spread(df: DataFrame) -> DataFrame:
    """Deal a table out to tasks of bounded row numbers before costly row work.

    Splits are cut by bytes, and a Parquet row group stands whole in one of them: a few splits may hold all rows, and millions of short
    rows fit in one. So the rows of each split are counted first (of Parquet that reads row group headers, no column); a table whose
    splits keep all cores busy with at most ``ROWS_A_TASK`` rows each passes through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    held = df.groupBy(F.spark_partition_id().alias("__split")).agg(F.count("*").alias("__rows"))
    filled, rows, largest = held.agg(F.count("*"), F.sum("__rows"), F.max("__rows")).first()
    if filled >= cores and largest <= ROWS_A_TASK:
        return df
    return df.repartition(max(cores, -(-(rows or 0) // ROWS_A_TASK)))
