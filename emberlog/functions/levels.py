"""Severity levels: aliases, inference from text, HTTP status and syslog priority."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.functions.text import null_if_empty, unicode_re

# Level words, aliases, failure words, rank.
LEVEL_WORD = (
    r"\b(TRACE|DEBUG|INFO|NOTICE|WARN|WARNING|ERROR|ERR|FATAL|CRITICAL|CRIT|ALERT|EMERG)\b"
)
FAILURE_WORD = (
    r"\b(exception|failed|failure|timeout|refused|denied|oom|panic|deadlock|502|503|504)\b"
)
LEVEL_ALIASES = {
    "WARN": "WARNING",
    "ERR": "ERROR",
    "CRIT": "CRITICAL",
    "ALERT": "CRITICAL",
    "EMERG": "CRITICAL",
    "SEVERE": "ERROR",
}
SEVERITY_RANK = {"INFO": 0, "WARNING": 1, "ERROR": 2, "FATAL": 3, "CRITICAL": 4}


def normalize_level(col: Column) -> Column:
    upper = F.upper(col)
    known = reduce(lambda case, item: case.when(upper == item[0], item[1]), LEVEL_ALIASES.items(), F)
    return known.otherwise(upper)


def level_word(col: Column) -> Column:
    return null_if_empty(F.regexp_extract(col, unicode_re(LEVEL_WORD, "i"), 1))


def inferred_word(col: Column) -> Column:
    """Level of a text before aliases are folded: its first level word, else ERROR by failure words, else INFO."""
    failed = F.when(col.rlike(unicode_re(FAILURE_WORD, "i")), "ERROR")
    return F.coalesce(level_word(col), failed, F.lit("INFO"))


def infer_level(col: Column) -> Column:
    return normalize_level(inferred_word(col))


def level_from_status(col: Column) -> Column:
    """ERROR from 500, WARNING from 400, else INFO; NULL when the text is not an integer."""
    number = F.when(col.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(col).cast("double"))
    return (
        F.when(number >= 500, "ERROR").when(number >= 400, "WARNING").when(number.isNotNull(), "INFO")
    )


def level_from_priority(col: Column) -> Column:
    severity = F.pmod(col.try_cast("bigint"), F.lit(8))
    return (
        F.when(severity <= 2, "CRITICAL")
        .when(severity == 3, "ERROR")
        .when(severity == 4, "WARNING")
        .otherwise("INFO")
    )


def severity_rank(col: Column) -> Column:
    known = reduce(lambda case, item: case.when(col == item[0], item[1]), SEVERITY_RANK.items(), F)
    return known.otherwise(0)
