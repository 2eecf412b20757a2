"""Hard negatives: for an anchor and each of its positives, the best rows of other labels within a window below the positive's score.

Scores are exact integer inner products. A block of anchors is multiplied with a block of rows modulo several small primes in float32:
residues are centred and the vector is cut so that every sum stays below 2^24, where float32 is exact. Chinese remaindering with
signed digits gives the score back; the largest norms of the table say how many primes hold every score. Two passes follow: the best
rows of the anchor's own label are its positives, then each positive's score spans a window for the rows of other labels.

Anchors are a stated share of the rows. They are cut into groups of at most ``GROUP`` and rows into slices; a *cell* is one
group and one slice. A task holds its cell's anchors and the few best rows of each so far, and lets the slice's rows stream by, so
no label, vector or anchor gathers in one task; each cell hands on ``k`` rows a window, and the cells' lists are merged by a window
that keeps the first ``k``.

Defined results: rows with a null label, a null vector, a null or non-finite component, or a squared norm of 2^62 or more (their
scores need not fit a long) take no part; shorter vectors are filled up with zeros; ties go to the smaller id, a null id after all
others; rows that repeat an id stay apart, an anchor is no candidate of its own, but its repetition is; an empty table, or one
without anchors, gives no rows; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import staged

#: Anchors a task holds; rows of a slice at least; rows and anchors that are multiplied at once.
GROUP, SLICE, ROWS, ANCHORS = 262_144, 8_192, 4_096, 128
EXACT = 1 << 24
LAST = np.iinfo(np.int64).max
FOUND = "anchor long, window int, id long, score long, row long"


def primes_for(bound: int, largest: int = 1024) -> list[int]:
    """The largest primes below ``largest`` whose product exceeds twice ``bound``: they tell all scores up to it apart."""
    sieve = [n for n in range(3, largest, 2) if all(n % k for k in range(3, math.isqrt(n) + 1, 2))]
    chosen: list[int] = []
    while math.prod(chosen) <= 2 * bound:
        chosen.append(sieve.pop())
    return chosen


def residues(vectors: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """For each prime the components' residues nearest to zero, as float32."""
    return [(np.mod(vectors + p // 2, p) - p // 2).astype(np.float32) for p in primes]


def products(left: list[np.ndarray], right: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact inner products of all rows of ``left`` and ``right``, given by residues."""
    total, radix = np.zeros((len(left[0]), len(right[0])), np.int64), 1
    for p, a, b in zip(primes, left, right, strict=True):
        width = EXACT // (p // 2) ** 2
        rest = np.zeros(total.shape, np.int64)
        for at in range(0, a.shape[1], width):
            rest += (a[:, at : at + width] @ b[:, at : at + width].T).astype(np.int64)
        digit = np.mod((rest - total) % p * pow(radix, -1, p) + p // 2, p) - p // 2
        total += digit * radix
        radix *= p
    return total


class _Best:
    """The ``k`` best rows of each window of a block of anchors: highest score, then smallest id."""

    def __init__(self, windows: int, k: int):
        self.k = k
        self.entry, self.score, self.ident, self.code = (np.empty(0, np.int64) for _ in range(4))
        self.least = np.full(windows, np.iinfo(np.int64).min)
        self.last = np.full(windows, LAST)

    def add(self, entry: np.ndarray, score: np.ndarray, ident: np.ndarray, code: np.ndarray) -> None:
        good = (score > self.least[entry]) | (ident < self.last[entry])
        parts = [np.concatenate([old, new[good]]) for old, new in ((self.entry, entry), (self.score, score), (self.ident, ident), (self.code, code))]
        order = np.lexsort((parts[2], -parts[1], parts[0]))
        sorted_entry = parts[0][order]
        rank = np.arange(len(order)) - np.searchsorted(sorted_entry, sorted_entry)
        self.entry, self.score, self.ident, self.code = (part[order[rank < self.k]] for part in parts)
        full = np.flatnonzero(rank == self.k - 1)
        self.least[sorted_entry[full]] = parts[1][order[full]]
        self.last[sorted_entry[full]] = parts[2][order[full]]


class _Anchors:
    """A block of a cell's anchors with their windows."""

    def __init__(self, block: dict, primes: list[int], dims: int, same_label: bool, k: int):
        self.row, self.label, self.same, self.primes = block["row"], block["label"], same_label, primes
        self.parts = residues(_matrix(block["vec"], dims), primes)
        self.of = np.repeat(np.arange(len(self.row)), [len(x) for x in block["low"]])
        self.number = np.concatenate([np.arange(len(x)) for x in block["low"]])
        self.low, self.high = (np.array([v for x in block[c] for v in x], np.int64) for c in ("low", "high"))
        self.best = _Best(len(self.of), k)

    def see(self, rows: dict, parts: list[np.ndarray]) -> None:
        score = products(self.parts, parts, self.primes)
        fits = (self.label[:, None] == rows["label"]) == self.same
        fits &= self.row[:, None] != rows["row"]
        floor = np.maximum(self.low, self.best.least)
        entry, at = np.nonzero(fits[self.of] & (score[self.of] >= floor[:, None]) & (score[self.of] <= self.high[:, None]))
        if len(entry):
            self.best.add(entry, score[self.of[entry], at], rows["id"][at], rows["code"][at])

    def found(self) -> pa.RecordBatch:
        best = self.best
        columns = [self.row[self.of[best.entry]], self.number[best.entry].astype(np.int32), best.ident, best.score, best.code]
        arrays = [pa.array(c, mask=best.code < 0 if i == 2 else None) for i, c in enumerate(columns)]
        return pa.RecordBatch.from_arrays(arrays, ["anchor", "window", "id", "score", "row"])


def _matrix(vectors: list[np.ndarray], dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), np.int64)
    for at, vector in enumerate(vectors):
        out[at, : len(vector)] = vector
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], dict]]:
    """Runs of rows of one cell and kind, at most ``ROWS`` at a time, as arrays."""
    for batch in batches:
        cell, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        cuts = [0, *(np.flatnonzero((np.diff(cell) != 0) | (np.diff(kind) != 0)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:], strict=False):
            for at in range(start, end, ROWS if kind[start] else ANCHORS):
                part = batch.slice(at, min(end, at + (ROWS if kind[start] else ANCHORS)) - at)
                row, ident = part.column(2).to_numpy(), part.column(3)
                block = {
                    "row": row, "id": ident.fill_null(LAST).to_numpy(), "label": part.column(4).to_numpy(),
                    "code": np.where(ident.is_null().to_numpy(zero_copy_only=False), -1 - row, row),  # negative where the id is null
                    "vec": [v.values.to_numpy(zero_copy_only=False) for v in part.column(5)],
                }
                if not kind[start]:
                    block |= {"low": part.column(6).to_pylist(), "high": part.column(7).to_pylist()}
                yield (int(cell[start]), int(kind[start])), block


def _search(primes: list[int], dims: int, same_label: bool, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cell in groupby(_blocks(batches), key=lambda x: x[0][0]):
            held: list[_Anchors] = []
            for (_, kind), block in cell:
                if not kind:
                    held.append(_Anchors(block, primes, dims, same_label, k))
                elif held:
                    parts = residues(_matrix(block["vec"], dims), primes)
                    for anchors in held:
                        anchors.see(block, parts)
            yield from (anchors.found() for anchors in held)

    return search


def _best_rows(rows: DataFrame, anchors: DataFrame, plan: dict, same_label: bool, k: int) -> DataFrame:
    """``anchor, window, id, score, rank``: the first ``k`` rows of each window of each anchor."""
    groups, slices = plan["groups"], plan["slices"]
    part = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = F.lit(None).cast("array<long>")
    left = anchors.select(part(groups).alias("group"), every(slices).alias("slice"), F.lit(0).alias("kind"), "row", "id", "label", "vec", "low", "high")
    right = rows.select(every(groups).alias("group"), part(slices).alias("slice"), F.lit(1).alias("kind"), "row", "id", "label", "vec", none.alias("low"), none.alias("high"))
    both = left.unionByName(right).select((F.col("group") * slices + F.col("slice")).alias("cell"), "kind", "row", "id", "label", "vec", "low", "high")
    cells = both.repartitionById(groups * slices, F.col("cell")).sortWithinPartitions("cell", "kind")
    found = cells.mapInArrow(_search(plan["primes"], plan["dims"], same_label, k), FOUND)
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("row")


def hard_negatives(
    vectors: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchor`` says which rows are anchors. Components are multiplied by ``scale`` and rounded down; a negative's score lies between
    ``low`` and ``high`` hundredths of the positive's.
    """
    whole = F.transform(vectors[vector], lambda x: x.cast("double") * scale)
    finite = F.forall(whole, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2.0**31), F.lit(False)))
    valid = vectors.where(vectors[label].isNotNull() & vectors[vector].isNotNull() & finite)
    rows = valid.select(
        F.monotonically_increasing_id().alias("row"), vectors[key].cast("long").alias("id"), vectors[label].cast("long").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"), F.transform(whole, lambda x: F.floor(x).cast("int")).alias("vec"),
    )
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    rows = staged(rows.withColumn("norm", norm).where(F.col("norm") < 2.0**62), "vectors")
    most = rows.agg(F.max("norm"), F.max(F.when(F.col("anchor"), F.col("norm"))), F.max(F.size("vec")), F.count("*"), F.count_if("anchor")).first()
    bound = 1 + math.isqrt(int((most[0] or 0) * 1.0001)) * (1 + math.isqrt(int((most[1] or 0) * 1.0001))) * 2
    groups = max(1, -(-most[4] // GROUP))
    plan = {"primes": primes_for(bound), "dims": most[2] or 0, "groups": groups, "slices": max(1, most[3] // max(SLICE, -(-most[4] // groups)))}
    own = rows.where("anchor").select("row", "id", "label", "vec")
    ends = F.lit(2**62)
    everything = own.withColumns({"low": F.array(-ends), "high": F.array(ends)})
    near = staged(_best_rows(rows, everything, plan, True, positives).select("anchor", "rank", "id", "score"), "positives")
    at_least = lambda s, share: -F.floor(-s.cast("decimal(20,0)") * share / 100).cast("long")
    at_most = lambda s, share: F.floor(s.cast("decimal(20,0)") * share / 100).cast("long")
    listed = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("near"))
    spans = listed.select(
        F.col("anchor").alias("row"), F.transform("near", lambda p: at_least(p["score"], low)).alias("low"), F.transform("near", lambda p: at_most(p["score"], high)).alias("high")
    )
    far = _best_rows(rows, own.join(spans, "row"), plan, False, negatives)
    pairs = near.select("anchor", F.col("rank").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = far.select("anchor", (F.col("window") + 1).alias("window"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = own.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    joined = found.join(pairs, ["anchor", "window"]).join(named, "anchor")
    return joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vec, row_number() OVER () AS own
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.own, a.label = v.label AS same, v.vec_id, CAST(list_inner_product(a.vec, v.vec) AS BIGINT) AS score
  FROM v AS a JOIN v ON a.own <> v.own WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.own, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.own = p.own AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
QUALIFY rank <= 5
"""
