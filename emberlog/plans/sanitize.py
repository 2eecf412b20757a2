"""The whole sanitising job: lines in, safe lines, counts and examples out."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.secrets import MODES, placeholder, preview
from emberlog.functions.text import MARK_SEP, strip_column
from emberlog.operators.correlate import number_values, renumber
from emberlog.operators.redact import matches, redact
from emberlog.session import configure, staged

EXAMPLES_KEPT = 3


class Sanitized:
    """Lazy results over redacted lines. Each frame redacts anew when it is run, unless ``once`` has written the lines.

    ``lines``: scope, pos, line, kind, sanitized, n_matches and the other columns of the input; ``matches``: scope, place, category,
    original; ``categories``: scope, category, n; ``summary``: scope, total_lines, transformed_lines, total_matches; ``examples``:
    scope, n, category, original_preview, replacement_preview.
    """

    def __init__(self, redacted: DataFrame, mode: str, numbered: bool, salt: str, written: bool):
        self.redacted, self.mode, self.numbered, self.salt, self.written = redacted, mode, numbered, salt, written

    def once(self) -> Sanitized:
        """The same over lines that are redacted now, in one job, and written to the shared checkpoint folder: for several results."""
        if self.written:
            return self
        return Sanitized(staged(self.redacted, "redacted"), self.mode, self.numbered, self.salt, True)

    @cached_property
    def matches(self) -> DataFrame:
        return matches(self.redacted)

    @cached_property
    def _numbers(self) -> DataFrame | None:
        return number_values(self.matches) if self.numbered else None

    @cached_property
    def _counted(self) -> DataFrame:
        return self.redacted.withColumn("n_matches", F.size("hits")).drop("hits").withColumnRenamed("redacted", "sanitized")

    @cached_property
    def lines(self) -> DataFrame:
        if self._numbers is None:
            return self._counted
        some = renumber(self._counted.where(F.col("n_matches") > 0), "sanitized", ["scope", "pos"], self._numbers)
        return some.unionByName(self._counted.where(F.col("n_matches") <= 0))

    @cached_property
    def categories(self) -> DataFrame:
        return self.matches.groupBy("scope", "category").agg(F.count("*").alias("n"))

    @cached_property
    def summary(self) -> DataFrame:
        return _summary(self._counted)

    @cached_property
    def examples(self) -> DataFrame:
        return _examples(self.matches, self.mode, self._numbers, self.salt)


def sanitize(lines: DataFrame, mode: str = "mask", preserve_correlation: bool = True, salt: str = "") -> Sanitized:
    """Sanitise ``lines(scope, pos, line)``; ``(scope, pos)`` must name a line.

    ``mode='mask'`` writes ``<CAT:n>`` (``<CAT>`` without correlation), ``mode='hash'`` writes ``<CAT:hash>``.
    Numbered masks run two jobs: one here writes the redacted lines and their values to the shared checkpoint folder, which all
    results then read; one numbers the distinct values when a result needs them. Only lines with a value travel to get its number.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    configure(lines.sparkSession)
    numbered = mode == "mask" and preserve_correlation
    result = Sanitized(redact(lines, mode, numbered, salt), mode, numbered, salt, False)
    return result.once() if numbered else result


def _summary(lines: DataFrame) -> DataFrame:
    return lines.groupBy("scope").agg(
        F.count_if(strip_column(F.col("line")) != "").alias("total_lines"),
        F.count_if(F.col("sanitized") != F.col("line")).alias("transformed_lines"),
        F.sum("n_matches").alias("total_matches"),
    )


def _examples(found: DataFrame, mode: str, numbers: DataFrame | None, salt: str) -> DataFrame:
    """The first three values of each category, in the order they are met; each task ships at most three of each."""
    order = Window.partitionBy("scope", "category").orderBy("place")
    first = found.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= EXAMPLES_KEPT)
    new = placeholder(F.col("category"), F.col("original"), mode, numbers is not None, salt)
    first = first.withColumn("__text", F.concat_ws(MARK_SEP, "original", new)).drop("original")
    if numbers is not None:
        first = renumber(first, "__text", ["scope", "category", "__n"], numbers)
    both = F.split("__text", MARK_SEP, -1)
    # At most three rows per category are left in a scope.
    n = F.row_number().over(Window.partitionBy("scope").orderBy("place"))
    return first.select(
        "scope",
        n.alias("n"),
        "category",
        preview(both[0]).alias("original_preview"),
        both[1].alias("replacement_preview"),
    )
