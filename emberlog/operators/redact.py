"""Find and replace secrets: twenty text rules in order, each on the result of the one before.

Spark has no replace by a function of the match, so a rule works in two steps: one ``regexp_replace`` puts inner marks
around the values it found, and where there are marks the text is split at them, the odd pieces are replaced, and the
pieces are joined. Lines a rule does not hit pay one regex search for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.plan import Steps, add, let, replay, settled
from emberlog.functions.secrets import TEXT_RULES, may_match, passes_luhn, placeholder, rule_regex
from emberlog.functions.text import MARK_OPEN, MARK_SEP, folded, restore_marks
from emberlog.operators.segments import reassembled, searchable, write_segments

HIT = "array<struct<seg:int,rule:int,idx:int,category:string,original:string>>"
#: The analyzer goes over an expression once for each level of nesting, so not all rules can be one.
RULES_A_STEP = 5
HINTED = 0  # rule number of a value found by its field name; text rules count from 1


def redact(lines: DataFrame, mode: str, correlate: bool, salt: str = "") -> DataFrame:
    """Add ``kind``, ``redacted`` and ``hits`` to ``lines(scope, pos, line)``.

    With ``correlate`` the placeholders hold identity keys, to be numbered by ``correlate.renumber``.
    """
    keep = lines.columns
    df = replay(lines, _write_steps, mode, correlate, salt)
    return df.select(*keep, *[settled(F.col(name)).alias(name) for name in ("kind", "redacted", "hits")])


def _write_steps(df: Steps, mode: str, correlate: bool, salt: str) -> None:
    write_segments(df)
    segments = F.col("__segments")
    named = F.filter(
        F.transform(
            segments,
            lambda s, i: F.struct(
                i.alias("seg"), F.lit(HINTED).alias("rule"), F.lit(0).alias("idx"),
                s["cat"].alias("category"), restore_marks(s["txt"]).alias("original"),
            ),
        ),
        lambda h: h["category"].isNotNull(),
    )
    add(df, {"__text": searchable(segments), "__hits": F.when(F.col("kind") == "text", F.array().cast(HIT)).otherwise(named.cast(HIT))})
    add(df, "__low", folded(F.col("__text")))
    # Several rules to a projection: a row that is written anew after each rule is copied forty times, its segments included.
    add(df, "__found", F.struct(F.col("__text").alias("text"), F.col("__hits").alias("hits")))
    for first in range(0, len(TEXT_RULES), RULES_A_STEP):
        found = F.col("__found")
        for number, rule in enumerate(TEXT_RULES[first : first + RULES_A_STEP], first + 1):
            found = let(found, _rule(rule, number, mode, correlate, salt))
        add(df, "__found", found)
    add(df, {"__results": F.split("__found.text", MARK_SEP, -1), "__hits": F.col("__found.hits")})
    results = F.transform(
        segments,
        lambda s, i: F.when(s["cat"].isNull(), F.col("__results")[i]).otherwise(
            placeholder(s["cat"], restore_marks(s["txt"]), mode, correlate, salt)
        ),
    )
    add(df, "__results", F.when(F.col("kind") == "text", F.col("__results")).otherwise(results))
    whole = reassembled(F.col("kind"), segments, F.col("__results"))
    whole = restore_marks(F.when(F.col("kind") == "blank", F.col("__line")).otherwise(whole))
    add(df, {"redacted": whole, "hits": F.col("__hits")})


def _rule(rule, number: int, mode: str, correlate: bool, salt: str):
    """One rule over ``struct<text, hits>``."""
    replace = _replace(rule, mode, correlate, salt)

    def one(s):
        def replaced(marked):
            text = F.array_join(F.transform(F.split(marked, MARK_OPEN, -1), replace), "")
            new = F.struct(text.alias("text"), F.concat(s["hits"], _hits(marked, rule, number)).alias("hits"))
            return F.when(marked.contains(MARK_OPEN), new).otherwise(s)

        marked = F.regexp_replace(s["text"], rule_regex(rule), f"$1{MARK_OPEN}$2{MARK_OPEN}$3")
        return F.when(may_match(rule, F.col("__low")), let(marked, replaced)).otherwise(s)

    return one


def _replace(rule, mode: str, correlate: bool, salt: str):
    def one(piece, i):
        new = placeholder(F.lit(rule.category), restore_marks(piece), mode, correlate, salt)
        wanted = (i % 2 == 1) & passes_luhn(piece) if rule.card else i % 2 == 1
        return F.when(wanted, new).otherwise(piece)

    return one


def _hits(marked: Column, rule, number: int) -> Column:
    """The replaced values of a rule with the segment they stand in; no rule runs over the end of a segment."""

    def of_segment(text, segment):
        def one(piece, i):
            return F.struct(
                segment.alias("seg"), F.lit(number).alias("rule"), i.alias("idx"),
                F.lit(rule.category).alias("category"), restore_marks(piece).alias("original"),
            )

        pieces = F.transform(F.split(text, MARK_OPEN, -1), one)
        found = F.filter(pieces, lambda h: h["idx"] % 2 == 1)
        found = F.filter(found, lambda h: passes_luhn(h["original"])) if rule.card else found
        return F.when(text.contains(MARK_OPEN), found.cast(HIT)).otherwise(F.array().cast(HIT))

    return F.flatten(F.transform(F.split(marked, MARK_SEP, -1), of_segment)).cast(HIT)


def matches(redacted: DataFrame) -> DataFrame:
    """One row per replaced value, with its place in the order values are met."""
    return redacted.select("scope", "pos", F.explode("hits").alias("h")).select(
        "scope",
        F.struct(
            F.col("pos"), F.col("h.seg").alias("seg"), F.col("h.rule").alias("rule"), F.col("h.idx").alias("idx")
        ).alias("place"),
        F.col("h.category").alias("category"),
        F.col("h.original").alias("original"),
    )
