"""The whole root-cause analysis: records in, summary, groups and insights out."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from emberlog.operators import classify as C
from emberlog.operators import groups as G
from emberlog.operators.counts import count_patterns
from emberlog.operators.formats import parse_records
from emberlog.operators.summary import summary
from emberlog.session import configure
from emberlog.sources.rules import Rule, load_rules

MIN_GROUPS, MAX_GROUPS, DEFAULT_GROUPS = 1, 50, 10
COLUMNS = ["scope", "rank", "pattern", "count", "level", "service", "source_type", "classification"]


class Analysis:
    """Results of one pass over the records, all lazy frames over its counts: ``counted`` as ``counts.count_patterns`` gives them."""

    def __init__(self, counted: DataFrame, max_groups: int = DEFAULT_GROUPS, rules: list[Rule] | None = None, examples: bool = True):
        self.counted, self.max_groups, self.examples = counted, max_groups, examples
        self.rules = load_rules() if rules is None else rules

    @cached_property
    def stats(self) -> DataFrame:
        return G.pattern_stats(self.counted)

    @cached_property
    def summary(self) -> DataFrame:
        return summary(self.stats)

    @cached_property
    def source_types(self) -> DataFrame:
        return G.source_counts(self.stats)

    @cached_property
    def groups(self) -> DataFrame:
        top = C.classify(G.ranked(G.error_groups(self.stats), self.max_groups), self.rules)
        if not self.examples:
            return top.select(*COLUMNS)
        return G.with_examples(top.select("pattern_key", *COLUMNS), G.group_examples(self.counted)).select(*COLUMNS, "examples")

    @cached_property
    def insights(self) -> DataFrame:
        return C.insights(self.counted.sparkSession, C.classify(G.error_groups(self.stats), self.rules), self.rules)


def analyze(
    records: DataFrame,
    source_type: str = "auto",
    max_groups: int = DEFAULT_GROUPS,
    rules: list[Rule] | None = None,
    examples: bool = True,
) -> Analysis:
    """Analyse ``records(scope, pos, raw, n_lines)``; each scope is a unit of its own.

    Runs one job, which reads the records once and writes their counts (with the first examples of each pattern) to the shared
    checkpoint folder; all results read these.
    """
    if not MIN_GROUPS <= max_groups <= MAX_GROUPS:
        raise ValueError(f"max_groups must be between {MIN_GROUPS} and {MAX_GROUPS}")
    configure(records.sparkSession)
    patterned = G.with_pattern(parse_records(records, source_type))
    return Analysis(count_patterns(patterned, examples), max_groups, rules, examples)
