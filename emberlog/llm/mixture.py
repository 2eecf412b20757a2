"""Mix sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Each source's documents are dealt by hash into shards of about ``SHARD_DOCS``; a shard is a stream of words in seeded order, cut into
blocks of equal size. Blocks are seats: they go to sources by highest quotients over the sources' targets, then each source's seats
go to its shards by highest quotients over their words. A shard with q seats and n blocks takes every block q div n times, and q mod
n blocks, chosen by seed, once more. Whole-document copies follow the words taken, the rounding carried on from document to document.

Defined results: null text has no words; null source is a source of its own, the last; documents without words are taken 0 words and
copied once; rows that repeat a key are documents of their own; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import fresh, staged, word_count

SHARD_DOCS, SHARD_BLOCKS, MOST, WEIGHTS, SEED = 500, 256, 3, (1, 2, 3), 42


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``src, source_size, docs, target``: shares of all words by weight, no more than ``most`` times a source's size, the excess reshared.

    Sources in order of their caps by weight are full as long as the level, what is left by what weight is left, reaches their cap.
    The windows without partitions see one row a source.
    """
    sources = sizes.groupBy("src").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    place = F.row_number().over(Window.orderBy("src")) - 1
    sources = sources.withColumn("weight", F.get(F.lit(list(weights)), place % len(weights)).cast("double"))
    sources = sources.withColumn("cap", F.col("source_size") * most).withColumn("full_at", F.col("cap") / F.col("weight"))
    by_level = Window.orderBy("full_at", "src")
    left = F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sources = sources.withColumn("level", left / F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "src", "level"))).over(Window.partitionBy())["level"]
    target = F.when(F.col("cap") < level * F.col("weight"), F.col("cap").cast("double")).otherwise(level * F.col("weight"))
    return sources.select("src", "source_size", "docs", target.alias("target"))


def apportion(cells: DataFrame, votes: str, seats: str, ident: str, group: list[str]) -> DataFrame:
    """Sainte-Lague: ``cells`` and a column ``quota``, which gives each group's ``seats`` to its cells by highest v/1, v/3, v/5, ...

    A divisor that must be too large gives each cell seats it surely has, one that must be too small the most it can have; only the
    quotients between them, at most two a cell, are ranked.
    """
    of = Window.partitionBy(*group)
    total, n = F.sum(votes).over(of), F.count("*").over(of)

    def rounded(by: Column) -> Column:
        return F.when((F.col(votes) > 0) & (by > 0), F.floor(F.col(votes) * by / F.col("_total") + F.lit(0.5))).otherwise(F.lit(0)).cast("long")

    bounded = cells.withColumn("_total", total).withColumn("_n", n)
    bounded = bounded.withColumns({"_sure": rounded(F.col(seats) - F.col("_n") / 2 - F.lit(1e-6)), "_most": rounded(F.col(seats) + F.col("_n") / 2 + F.lit(1e-6))})
    bounded = bounded.withColumn("_open", F.col(seats) - F.sum("_sure").over(of))
    seat = F.explode(F.sequence(F.col("_sure") + 1, F.col("_most")))
    asked = bounded.where(F.col("_most") > F.col("_sure")).select(*group, ident, "_open", votes, seat.alias("_seat"))
    rank = F.row_number().over(of.orderBy((F.col(votes) / (2 * F.col("_seat") - 1)).desc(), ident, "_seat"))
    won = asked.withColumn("_rank", rank).where(F.col("_rank") <= F.col("_open")).groupBy(*group, ident).agg(F.count("*").alias("_won"))
    keys = list(dict.fromkeys([*group, ident]))
    return bounded.join(won, keys, "left").withColumn("quota", F.col("_sure") + F.coalesce("_won", F.lit(0))).drop("_total", "_n", "_sure", "_most", "_open", "_won")


def take_blocks(sizes: np.ndarray, quota: int, blocks: int, seed: int, most: int = MOST) -> np.ndarray:
    """The words taken of each document of a stream: every block ``quota div blocks`` times, ``quota mod blocks`` seeded ones once more."""
    words = int(sizes.sum())
    if words == 0:
        return np.zeros(len(sizes), np.int64)
    quota = min(quota, most * blocks)
    times = np.full(blocks, quota // blocks, np.int64)
    times[np.random.default_rng(seed).permutation(blocks)[: quota % blocks]] += 1
    edges = np.arange(blocks + 1, dtype=np.int64) * words // blocks
    taken_before = np.concatenate([[0], np.cumsum(times * np.diff(edges))])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    at = np.clip(np.searchsorted(edges, ends, side="right") - 1, 0, blocks - 1)
    return np.diff(taken_before[at] + (ends - edges[at]) * times[at])


def whole_copies(sizes: np.ndarray, taken: np.ndarray, most: int = MOST) -> np.ndarray:
    """Copies of whole documents, 0 to ``most`` each, whose words follow ``taken``: what rounding leaves goes on to the next smaller one."""
    copies, carry = np.ones(len(sizes), np.int64), 0
    for k in np.argsort(-sizes, kind="stable").tolist():
        if size := int(sizes[k]):
            wish = int(taken[k]) + carry
            copies[k] = min(most, max(0, (2 * wish + size) // (2 * size)))
            carry = wish - int(copies[k]) * size
    return copies


def _take(seed: int, most: int):
    def take(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("order", "ascending"), ("key", "ascending"), ("size", "ascending")])
        sizes, first = table.column("size").to_numpy(), {name: table.column(name)[0].as_py() for name in ("src", "shard", "quota", "blocks")}
        taken = take_blocks(sizes, first["quota"], first["blocks"], zlib.crc32(f"{seed}|{first['shard']}|{first['src']}".encode()), most)
        out = table.select(["key", "size", "source_size", "target"])
        return out.append_column("taken", pa.array(taken)).append_column("copies", pa.array(whole_copies(sizes, taken, most)))

    return take


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: ``<key>, size, source_size, target, taken, copies``."""
    src = F.when(docs[source].isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), docs[source]))
    sizes = staged(docs.select(docs[key].alias("key"), src.alias("src"), word_count(docs[text]).alias("size")), "sizes")
    sources = staged(source_targets(sizes, weights, most), "targets").withColumn("shards", F.ceil(F.col("docs") / SHARD_DOCS))
    whole = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.coalesce(F.sum("shards"), F.lit(0)).alias("shards")).first()
    seats = whole["shards"] * SHARD_BLOCKS
    per_source = apportion(sources.withColumn("seats", F.lit(seats).cast("long")), "target", "seats", "src", []).withColumnRenamed("quota", "source_seats")
    shard = F.pmod(F.xxhash64("key", F.lit(seed)), F.col("shards"))
    dealt = sizes.join(sources.select("src", "source_size", "target", "shards"), "src").withColumn("shard", shard)
    cells = dealt.groupBy("src", "shard").agg(F.sum("size").alias("words"))
    cells = apportion(cells.join(per_source.select("src", "source_seats"), "src"), "words", "source_seats", "shard", ["src"])
    blocks = F.greatest(F.lit(1), F.round(F.col("words") * seats / F.lit(max(1, whole["words"])))).cast("int")
    cells = staged(cells.select("src", "shard", "quota", blocks.alias("blocks")), "cells")
    kind = docs.schema[key].dataType.simpleString()
    rows = dealt.join(cells, ["src", "shard"]).withColumn("order", F.xxhash64(F.lit(seed), "key"))
    taken = rows.groupBy("src", "shard").applyInArrow(_take(seed, most), f"key {kind}, size long, source_size long, target double, taken long, copies long")
    return taken.withColumnRenamed("key", key)


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """``docs`` with each row as often as the mix copies it; rows that repeat a key and size share the larger number."""
    of, size, n, words, copy = fresh("key", "size", "copies", "words", "copy")
    copies = mix(docs, key, text, source, **how).groupBy(F.col(key).alias(of), F.col("size").alias(size)).agg(F.max("copies").alias(n))
    sized = docs.withColumn(words, word_count(docs[text]))
    joined = sized.join(copies, sized[key].eqNullSafe(F.col(of)) & (F.col(words) == F.col(size)))
    return joined.where(F.col(n) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*[docs[c] for c in docs.columns])
