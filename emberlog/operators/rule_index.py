"""Classification by very many rules: an index of the texts that rules require, joined with the texts that patterns hold.

Most rules cannot match without some fixed text. Each rule is filed under fragments of such texts (one for each of its alternatives),
cut to a few lengths; each pattern looks up its own fragments of these lengths. Only pairs that share a fragment are tried with the
rule's regex, and the first rule that hits counts. Rules and patterns stay tables: no rule passes the driver but those that
require no text at all, which are tried on every pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.functions.text import folded, unicode_re

#: Lengths of fragments: a required text is cut to the longest of these that it has.
LENGTHS = (3, 4, 5, 6, 8, 10, 12, 16, 24)
_QUANTIFIERS = "?*+{"


class _Unclear(Exception):
    """The pattern uses a construct whose effect on required texts is not looked into."""


def required_texts(pattern: str) -> list[str] | None:
    """Lower-case texts, one of which every match of a case-blind regex holds; None if there are none of ``LENGTHS[0]`` characters.

    Only plain ASCII characters count; whatever else stands in the pattern ends a text, so the answer errs towards None.
    """
    try:
        found, at = _alternatives(pattern, 0)
    except _Unclear:
        return None
    return found if at == len(pattern) else None


def _alternatives(pattern: str, at: int) -> tuple[list[str] | None, int]:
    branches, ended = [], False
    while not ended:
        best, at = _sequence(pattern, at)
        branches.append(best)
        ended = at == len(pattern) or pattern[at] == ")"
        at += not ended  # the bar
    texts = [text for branch in branches for text in branch or ()]
    return (None if any(branch is None for branch in branches) else sorted(set(texts))), at


def _sequence(pattern: str, at: int) -> tuple[list[str] | None, int]:
    """The requirement of one branch: its best literal run or group."""
    choices: list[list[str]] = []
    run = ""

    def close() -> None:
        nonlocal run
        if len(run) >= LENGTHS[0]:
            choices.append([run])
        run = ""

    while at < len(pattern) and pattern[at] not in "|)":
        char, literal, inner = pattern[at], None, None
        if char == "(":
            looks, at = _group_start(pattern, at)
            inner, at = _alternatives(pattern, at)
            if at == len(pattern):
                raise _Unclear
            at += 1
            inner = None if looks else inner
        elif char == "[":
            at = _class_end(pattern, at)
        elif char == "\\":
            if at + 1 == len(pattern) or pattern[at + 1] in "QExucpPkN0":
                raise _Unclear
            literal = pattern[at + 1] if not pattern[at + 1].isalnum() and pattern[at + 1].isascii() else None
            at += 2
        else:
            literal = char if char.isascii() and char not in ".^$" else None
            at += 1
        quantifier, at = _quantifier(pattern, at)
        optional = quantifier[:1] in ("?", "*") or quantifier.startswith(("{0", "{,"))
        if literal is not None and not quantifier:
            run += literal.lower()
            continue
        if literal is not None and not optional:
            run += literal.lower()
        close()
        if inner and not optional:
            choices.append(inner)
    close()
    return max(choices, key=lambda c: (min(map(len, c)), -len(c)), default=None), at


def _group_start(pattern: str, at: int) -> tuple[bool, int]:
    """Whether a group only looks around, and where its content begins."""
    if not pattern.startswith("(?", at):
        return False, at + 1
    for head, looks in (("(?:", False), ("(?=", True), ("(?!", True), ("(?<=", True), ("(?<!", True), ("(?>", False)):
        if pattern.startswith(head, at):
            return looks, at + len(head)
    raise _Unclear  # flags, named groups


def _class_end(pattern: str, at: int) -> int:
    start = at + 1 + pattern.startswith("^", at + 1)
    end = start + 1 if pattern.startswith("]", start) else start
    while end < len(pattern) and pattern[end] != "]":
        if pattern[end] == "[" or pattern.startswith("&&", end):
            raise _Unclear
        end += 2 if pattern[end] == "\\" else 1
    if end >= len(pattern):
        raise _Unclear
    return end + 1


def _quantifier(pattern: str, at: int) -> tuple[str, int]:
    end = at
    if at < len(pattern) and pattern[at] in _QUANTIFIERS:
        end = pattern.index("}", at) + 1 if pattern[at] == "{" and "}" in pattern[at:] else at + 1
        if end < len(pattern) and pattern[end] in "?+":
            end += 1
    return pattern[at:end], end


def _fragment(text: str) -> str:
    return text[-max(n for n in LENGTHS if n <= len(text)) :]


def _fragments(pattern: str) -> list[str] | None:
    texts = required_texts(pattern)
    return None if texts is None else sorted({_fragment(text) for text in texts})


def indexed(rules: DataFrame) -> DataFrame:
    """``priority, pattern, fragments`` of the rules that have a pattern; ``fragments`` is null for those that require no text."""
    fragments = F.udf(_fragments, T.ArrayType(T.StringType()), useArrow=False)("pattern")
    return rules.where(F.coalesce(F.col("pattern"), F.lit("")) != "").select("priority", "pattern", fragments.alias("fragments"))


def first_rule(texts: DataFrame, filed: DataFrame) -> DataFrame:
    """``text, rule_priority`` for each of the distinct ``texts(text)`` that some rule of ``filed`` hits, by shared fragments."""
    low = folded(F.col("text"))
    named = texts.withColumn("__id", F.xxhash64("text"))

    def pieces(length: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length("__low") - length + 1, F.lit(1)))
        return F.transform(starts, lambda at: F.substring(F.col("__low"), at, F.lit(length)))

    held = named.select("__id", low.alias("__low")).select("__id", F.explode(F.array_distinct(F.flatten(F.array(*[pieces(n) for n in LENGTHS])))).alias("__fragment"))
    wanted = filed.where(F.col("fragments").isNotNull()).select("priority", "pattern", F.explode("fragments").alias("__fragment"))
    pairs = held.join(wanted, "__fragment").select("__id", "priority", "pattern").distinct()
    flags = unicode_re("", "i")
    tried = pairs.join(named, "__id").where(F.call_function("regexp_like", "text", F.concat(F.lit(flags), "pattern")))
    return tried.groupBy("text").agg(F.min("priority").alias("rule_priority"))
