"""First-match classification of groups, and one insight per class."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.functions.text import unicode_re
from emberlog.operators import rule_index
from emberlog.session import staged
from emberlog.sources.rules import Rule, rules_table

UNKNOWN = "UNKNOWN"
#: Rules in one CASE.
BLOCK_RULES = 200


def _blocks(rules: Iterable[Rule]) -> Iterator[list[Rule]]:
    rules = iter(rules)
    while block := list(islice(rules, BLOCK_RULES)):
        yield block


def rule_priority(pattern: Column, rules: list[Rule]) -> Column:
    """Priority of the first rule whose pattern occurs, ignoring case; NULL for none.

    Each block of rules is a CASE of its own; a later block is tried only where no earlier one hit.
    """
    tests = []
    for block in _blocks(r for r in rules if r.pattern):
        tests.append(reduce(lambda c, r: c.when(pattern.rlike(unicode_re(r.pattern, "i")), r.priority), block, F))
    return F.coalesce(*tests) if tests else F.lit(None).cast("int")


def classify(groups: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add ``rule_priority`` and ``classification``. The rules are driver-side literals: no join, no shuffle."""
    df = groups.withColumn("rule_priority", rule_priority(F.col("pattern"), rules))
    names = [reduce(lambda c, r: c.when(F.col("rule_priority") == r.priority, r.classification), block, F) for block in _blocks(rules)]
    return df.withColumn("classification", F.coalesce(*names, F.lit(UNKNOWN)))


def classify_by_table(groups: DataFrame, rules: DataFrame) -> DataFrame:
    """The same for rules that come as a table ``priority, pattern, classification``, of any number; priorities differ.

    Up to ``BLOCK_RULES`` rules become a CASE. More are filed by the texts they require (``rule_index``) and joined with the distinct
    patterns; of these only rules that require no text become a CASE. Patterns without a hit, null ones too, are ``UNKNOWN``.
    """
    named = rules.select("priority", "pattern", "classification")
    few = named.orderBy("priority").limit(BLOCK_RULES + 1).collect()
    if len(few) <= BLOCK_RULES:
        return classify(groups, [_rule(r) for r in few])
    filed = staged(rule_index.indexed(named), "rules")
    general = [_rule(r) for r in filed.where(F.col("fragments").isNull()).orderBy("priority").toLocalIterator()]
    texts = groups.where(F.col("pattern").isNotNull()).select(F.col("pattern").alias("text")).distinct()
    hits = rule_index.first_rule(texts, filed).select(F.col("text").alias("__text"), F.col("rule_priority").alias("__filed"))
    tried = groups.join(hits, F.col("pattern") == F.col("__text"), "left")
    first = F.least("__filed", rule_priority(F.col("pattern"), general))  # the one that is not null, if one is
    classes = named.select(F.col("priority").alias("__priority"), F.col("classification").alias("__class"))
    out = tried.withColumn("rule_priority", first).join(classes, F.col("rule_priority") == F.col("__priority"), "left")
    return out.withColumn("classification", F.coalesce("__class", F.lit(UNKNOWN))).drop("__text", "__filed", "__priority", "__class")


def _rule(row) -> Rule:
    fields = row.asDict()
    return Rule(fields["priority"], None, fields["pattern"] or "", fields.get("classification") or UNKNOWN, "", [], [])


def insights(spark: SparkSession, classified: DataFrame, rules: list[Rule]) -> DataFrame:
    """One insight per scope and class, of its best-ranked group, in the order of those groups."""
    order = F.struct((-F.col("count")).alias("c"), F.col("pattern_key"))
    best = (
        classified.where("rule_priority is not null")
        .groupBy("scope", "classification")
        .agg(F.min_by("rule_priority", order).alias("priority"), F.min(order).alias("__order"))
    )
    # At most one row per scope and class is left, so ranking them is small work.
    rank = F.row_number().over(Window.partitionBy("scope").orderBy("__order"))
    table = rules_table(spark, rules).drop("classification", "pattern", "name")
    return (
        best.withColumn("rank", rank)
        .join(F.broadcast(table), "priority")
        .select("scope", "rank", "title", "classification", "possible_causes", "recommended_actions")
    )
