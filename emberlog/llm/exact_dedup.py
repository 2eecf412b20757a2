"""Exact dedup with a heavy-hitter split.

Digests of the normalised texts are written once. Misra-Gries counters, one set a partition and summed up, find every digest that
holds ``share`` of all rows or more; an exact second pass over the candidates alone verifies their counts and picks their winners.
The winners, at most ``1 / share`` rows, are broadcast, so rows of a frequent text never meet in one task; the rest, groups of less
than ``share`` of all rows, goes through an ordinary shuffle by digest.

Defined results: null text counts as empty; empty texts are equal to each other and to texts of white space alone; of texts of one
length the smallest key stays, a null key after all others; rows that repeat the key of the row that stays are all kept; an empty
table gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import SPACES, fresh, staged, text_of

#: A digest with this share of all rows or more is frequent; counters of each partition: the sums fall short by rows/(COUNTERS + 1) at most.
SHARE, COUNTERS = 1 / 1000, 2000


def misra_gries(counts: dict[bytes, int], more: dict[bytes, int], counters: int) -> dict[bytes, int]:
    """The merge of two summaries: add up, then take the (counters + 1)-th largest count off all and drop what is left with none."""
    for key, n in more.items():
        counts[key] = counts.get(key, 0) + n
    if len(counts) > counters:
        off = sorted(counts.values(), reverse=True)[counters]
        counts = {key: n - off for key, n in counts.items() if n > off}
    return counts


def _summaries(counters: int):
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for batch in batches:
            found = batch.column(0).value_counts()
            counts = misra_gries(counts, dict(zip(found.field("values").to_pylist(), found.field("counts").to_pylist(), strict=True)), counters)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["digest", "seen"])

    return summarise


def frequent_digests(digests: DataFrame, share: float = SHARE, counters: int = COUNTERS) -> DataFrame:
    """Every digest with ``share`` of the rows or more, and its exact count and winner: ``digest, group_size, keep_id``.

    Estimates add up to the number of rows at most, so fewer than ``1 / (share - 1 / (counters + 1))`` candidates pass the threshold.
    """
    rows = digests.count()
    seen = digests.select("digest").mapInArrow(_summaries(counters), "digest binary, seen long").groupBy("digest").agg(F.sum("seen").alias("seen"))
    candidates = staged(seen.where(F.col("seen") > rows * (share - 1 / (counters + 1))).select("digest"), "frequent")
    verified = digests.join(F.broadcast(candidates), "digest").groupBy("digest").agg(F.count("*").alias("group_size"), F.min(_order()).alias("first"))
    return staged(verified.where(F.col("group_size") >= rows * share).select("digest", "group_size", F.col("first.key").alias("keep_id")), "winners")


def _order():
    """Least for the row that stays: the longest text, then the smallest key, null last."""
    return F.struct((-F.col("n_chars")).alias("less"), F.col("key").isNull().alias("none"), F.col("key").alias("key"))


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", share: float = SHARE, counters: int = COUNTERS) -> DataFrame:
    """One row per row of ``docs``: ``<key>, keep_id, group_size, kept, text_sha256``."""
    body = text_of(docs[text])
    digests = staged(
        docs.select(docs[key].alias("key"), F.unhex(F.sha2(F.translate(body, SPACES, "").cast("binary"), 256)).alias("digest"), F.char_length(body).alias("n_chars")),
        "digests",
    )
    marked = digests.join(F.broadcast(frequent_digests(digests, share, counters)), "digest", "left")
    group = Window.partitionBy("digest")
    rest = marked.where(F.col("group_size").isNull()).select(
        "key", "digest", F.count("*").over(group).alias("group_size"), F.min(_order()).over(group)["key"].alias("keep_id")
    )
    both = marked.where(F.col("group_size").isNotNull()).select("key", "digest", "group_size", "keep_id").unionByName(rest)
    return both.select(
        F.col("key").alias(key), "keep_id", "group_size", F.col("key").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay."""
    (stays,) = fresh("stays")
    stay = exact_groups(docs, key, text).where("kept").select(F.col(key).alias(stays)).distinct()
    return docs.join(stay, docs[key].eqNullSafe(F.col(stays)), "left_semi")


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) AS keep_id
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g
"""
