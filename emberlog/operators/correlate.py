"""Numbers for equal values: 1, 2, ... by first occurrence within scope and category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.secrets import KEY_LETTERS, identity_key
from emberlog.functions.text import MARK_CLOSE, MARK_OPEN
from emberlog.session import staged

KEYED = rf"(<[A-Z_]+:)([a-p]{{{KEY_LETTERS}}})"
#: Numbers of so many bytes, as their columns add up, are broadcast.
BROADCAST_BYTES = 16 << 20
#: A key with more than this part of a shuffle partition's fair share of all matches is hot; there are few such keys.
HOT_PART = 0.25


def number_values(matches: DataFrame) -> DataFrame:
    """``numbers(scope, key, number, n)`` of ``matches(scope, place, category, original)``, written once.

    Equal values are first reduced to one row (map-side too, so a value on a third of all lines is no load). The distinct
    values are written, cut into ranges of their order, and written again, which fixes the ranges; numbers are places within a
    range plus the sizes of the ranges before. No task sees a whole category, and each step runs once.
    """
    distinct = staged(
        matches.withColumn("key", identity_key(F.col("category"), F.col("original")))
        .groupBy("scope", "category", "key")
        .agg(F.min("place").alias("first"), F.count("*").alias("n")),
        "values",
    )
    ranges = staged(distinct.repartitionByRange("scope", "category", "first").withColumn("range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy("scope", "category").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranges.groupBy("scope", "category", "range")
        .agg(F.count("*").alias("__size"))
        .select("scope", "category", "range", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"))
    )
    place = F.row_number().over(Window.partitionBy("scope", "category", "range").orderBy("first"))
    numbered = (
        ranges.withColumn("__place", place)
        .join(offsets, ["scope", "category", "range"])
        .select("scope", "key", (F.col("__offset") + F.col("__place")).alias("number"), "n")
    )
    return staged(numbered, "numbers")


def renumber(df: DataFrame, text: str, ids: list[str], numbers: DataFrame) -> DataFrame:
    """Replace the identity keys in ``text`` by their numbers. ``ids`` (with ``scope``) name a row; other columns are kept.

    A text is cut into pieces that end in at most one key, so it travels once however many keys it has, and rows that
    share a hot key are not sent to one task: hot keys, or all if they are few, are joined by a size-checked broadcast.
    """
    rest = [c for c in df.columns if c not in ids and c != text]
    pieces = F.split(F.regexp_replace(text, KEYED, f"$1{MARK_OPEN}$2{MARK_CLOSE}"), f"[{MARK_OPEN}{MARK_CLOSE}]", -1)
    df = df.withColumn("__pieces", pieces)
    steps = F.sequence(F.lit(0), F.size("__pieces") - 1, F.lit(2))
    pairs = F.transform(
        steps, lambda i: F.struct(F.col("__pieces")[i].alias("lit"), F.get(F.col("__pieces"), i + 1).alias("key"))
    )
    rows = df.select(*ids, F.struct(*rest, F.lit(1).alias("__some")).alias("__rest"), F.posexplode(pairs).alias("__i", "__p")).select(
        *ids,
        "__i",
        F.when(F.col("__i") == 0, F.col("__rest")).alias("__rest"),  # the other columns travel with the first piece only
        F.col("__p.lit").alias("__lit"),
        F.col("__p.key").alias("key"),
    )
    joined = _with_numbers(rows, numbers, F.hash(*ids))
    whole = F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.struct("__i", "__lit", F.coalesce(F.col("number").cast("string"), F.col("key"), F.lit("")).alias("v")))),
            lambda p: F.concat(p["__lit"], p["v"]),
        ),
        "",
    )
    return joined.groupBy(*ids).agg(whole.alias(text), F.first("__rest", ignorenulls=True).alias("__rest")).select(
        *ids, text, *[F.col(f"__rest.{c}").alias(c) for c in rest]
    )


def _with_numbers(rows: DataFrame, numbers: DataFrame, spread: Column) -> DataFrame:
    keys = numbers.select("scope", "key", "number")
    size = F.sum(F.octet_length("scope") + F.octet_length("key") + 24)
    held, total = numbers.agg(F.coalesce(size, F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if held <= BROADCAST_BYTES:
        return rows.join(F.broadcast(keys), ["scope", "key"], "left")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    is_hot = F.col("n") > F.lit(HOT_PART * total / parts)  # at most parts / HOT_PART of them
    hot = numbers.where(is_hot).select("scope", "key", F.col("number").alias("__hot"))
    cold = numbers.where(~is_hot).select("scope", F.col("key").alias("__key"), "number")
    rows = rows.join(F.broadcast(hot), ["scope", "key"], "left")
    # Pieces without a cold key get a key of their own that matches nothing, so that they spread.
    lone = F.col("key").isNull() | F.col("__hot").isNotNull()
    rows = rows.withColumn("__key", F.when(lone, F.concat(F.lit("-"), spread)).otherwise(F.col("key")))
    joined = rows.join(cold, ["scope", "__key"], "left")
    return joined.withColumn("number", F.coalesce("__hot", "number")).drop("__hot", "__key")
