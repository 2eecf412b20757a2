"""How five filters interact: what each removes in every order of the five, from a sparse document-term matrix.

A task cuts its documents into *shards* of about ``SHARD`` bytes of text. A shard's words get numbers of its own and its documents
become compressed sparse rows over them, written to the shared folder beside the list of the shard's words. The words of all shards
then meet, each word once a shard, in buckets of the word's hash, some ``BUCKET`` words each; a bucket gives them the numbers of one
global dictionary and sends each shard the numbers of its words, packed. Texts are read once and never shuffled, a task holds one
shard or one bucket, and a word that every document holds is as many entries as there are shards. Sums of a row are its
document's words, its nonzero entries the distinct ones: they decide filters A and B. C and D are decided where the text is read; E
compares sha256 of the texts: the first of equal texts is known by digest and smallest key together, so copies meet only in a
partial aggregate.

What is left is one of 32 sets of failures a document, counted by part; orders, losses and Shapley sums follow from these counts.

Defined results: null text is the empty one; a null source is the empty string; a null key comes after all others, so it fails E
beside any numbered copy, and never beside its like; rows that repeat key and text are copies of no smaller key and each is judged
alone; of a key's labels the largest counts; an empty table has no parts and gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import staged

#: Bytes of text in a shard, words of all shards in a bucket, about.
SHARD, BUCKET = 16 << 20, 1 << 20
FILTERS = "ABCDE"
MARKS = re.compile(b"[#$%&*|]")
CAPITALS = bytes(range(65, 91))
ROWS = "shard long, n_terms long, words binary, indptr binary, indices binary, counts binary, keys array<long>, parts array<string>, flags binary, digests binary"
_ROWS = pa.schema(
    [("shard", pa.int64()), ("n_terms", pa.int64()), ("words", pa.binary()), ("indptr", pa.binary()), ("indices", pa.binary()), ("counts", pa.binary()),
     ("keys", pa.list_(pa.int64())), ("parts", pa.list_(pa.string())), ("flags", pa.binary()), ("digests", pa.binary())]
)
JUDGED = "key long, part string, digest binary, fails int, n_words long, n_distinct long"
PACKED = "bucket int, shard long, places binary, words binary"
NUMBERED = "shard long, bucket int, places binary, numbers binary"


def _pack(data: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data if isinstance(data, bytes) else data.tobytes())


def _unpack(data: bytes, kind: str | None = None):
    raw = zstandard.ZstdDecompressor().decompress(data)
    return raw if kind is None else np.frombuffer(raw, kind)


class _Shard:
    """Documents as sparse rows over the shard's own word numbers."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {}
        self.indices, self.counts, self.sizes = [], [], []
        self.keys, self.parts, self.flags, self.digests, self.bytes = [], [], bytearray(), [], 0

    def add(self, key: int | None, part: str, text: str) -> None:
        body = text.encode()
        tally, numbers = Counter(body.split()), self.numbers
        self.indices.append(np.array([numbers.setdefault(word, len(numbers)) for word in tally], "<i4"))
        self.counts.append(np.fromiter(tally.values(), "<i4", len(tally)))
        self.sizes.append(len(tally))
        self.keys.append(key)
        self.parts.append(part)
        capitals = len(body) - len(body.translate(None, CAPITALS))
        self.flags.append(4 * (100 * capitals > 2 * len(text)) + 8 * (MARKS.search(body) is not None))
        self.digests.append(hashlib.sha256(body).digest())
        self.bytes += len(body) + 64

    def record(self, shard: int) -> pa.RecordBatch:
        values = (
            shard, len(self.numbers), _pack(b" ".join(self.numbers)), _pack(np.cumsum([0, *self.sizes]).astype("<i8")), _pack(np.concatenate(self.indices)),
            _pack(np.concatenate(self.counts)), self.keys, self.parts, bytes(self.flags), b"".join(self.digests),
        )
        return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(values, _ROWS, strict=True)], schema=_ROWS)


def _sharded(shard_bytes: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made, held = TaskContext.get().partitionId() << 32, 0, _Shard()
        for batch in batches:
            for key, part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                held.add(key, part, text.as_py())
                if held.bytes >= shard_bytes:
                    yield held.record(base + made)
                    made, held = made + 1, _Shard()
        if held.keys:
            yield held.record(base + made)

    return cut


def _dealt(buckets: int):
    """A shard's words by bucket, with their places in the shard."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = _unpack(packed.as_py()).split()
                bucket = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % buckets
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
                rows = [(k, shard, _pack(order[a:b].astype("<i4")), _pack(b" ".join([words[i] for i in order[a:b].tolist()]))) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "shard", "places", "words"])

    return deal


def _numbered(buckets: int):
    """Numbers for the words of a bucket, as its rows come in: the place of the word in the bucket, times all buckets, plus the bucket."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known = None, {}
        for batch in batches:
            numbers = []
            for bucket, packed in zip(batch.column(0).to_pylist(), batch.column(3), strict=True):
                if bucket != at:
                    at, known = bucket, {}
                own = [known.setdefault(word, len(known)) for word in _unpack(packed.as_py()).split()]
                numbers.append(_pack(np.array(own, "<i8") * buckets + bucket))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), batch.column(2), pa.array(numbers, pa.binary())], ["shard", "bucket", "places", "numbers"])

    return number


def document_terms(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source", shard_bytes: int = SHARD, bucket_words: int = BUCKET) -> DataFrame:
    """The document-term matrix: one row a shard, with its compressed sparse rows and, by bucket, the global numbers of its words."""
    rows = docs.select(docs[key].cast("long").alias("key"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"), F.coalesce(docs[text], F.lit("")).alias("text"))
    shards = staged(rows.mapInArrow(_sharded(shard_bytes), ROWS), "shards")
    terms = shards.agg(F.sum("n_terms")).first()[0] or 0
    buckets = 1 + terms // bucket_words
    dealt = shards.select("shard", "words").mapInArrow(_dealt(buckets), PACKED)
    met = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_numbered(buckets), NUMBERED)
    columns = met.groupBy("shard").agg(F.collect_list(F.struct("places", "numbers")).alias("columns"))  # as many bytes as the shard has words
    return shards.drop("words").join(columns, "shard", "left")


def sparse_rows(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``indptr, columns, counts`` of a shard of ``document_terms``, columns as global numbers."""
    columns = np.zeros(row["n_terms"], np.int64)
    for part in row["columns"] or []:
        columns[_unpack(part["places"], "<i4")] = _unpack(part["numbers"], "<i8")
    return _unpack(row["indptr"], "<i8"), columns[_unpack(row["indices"], "<i4")], _unpack(row["counts"], "<i4")


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Filters A to D of a shard's documents: a row's sum is its words, its nonzero entries the distinct ones."""
    for batch in batches:
        for at in range(batch.num_rows):
            row = {name: batch.column(name)[at].as_py() for name in ("n_terms", "columns", "indptr", "indices", "counts", "flags", "digests", "keys", "parts")}
            indptr, _, counts = sparse_rows(row)
            n_words = np.diff(np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])[indptr])
            distinct = np.diff(indptr)
            fails = np.frombuffer(row["flags"], np.uint8).astype(np.int32) + (n_words < 200) + 2 * (100 * distinct < 50 * n_words)
            digests = [row["digests"][i : i + 32] for i in range(0, len(row["digests"]), 32)]
            arrays = [pa.array(row["keys"], pa.int64()), pa.array(row["parts"]), pa.array(digests, pa.binary()), *(pa.array(x.astype(t)) for x, t in ((fails, np.int32), (n_words, np.int64), (distinct, np.int64)))]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "part", "digest", "fails", "n_words", "n_distinct"])


def failures(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source", shard_bytes: int = SHARD) -> DataFrame:
    """One row a document: ``key, part, fails, n_words, n_distinct``; bit k of ``fails`` is set where the k-th filter fails."""
    rows = staged(document_terms(docs, key, text, part, shard_bytes).mapInArrow(_judged, JUDGED), "judged")
    first = rows.groupBy("digest").agg(F.min("key").alias("first"))
    firsts = first.select(F.col("digest").alias("first_digest"), "first")
    joined = rows.join(firsts, rows["key"].eqNullSafe(firsts["first"]) & (rows["digest"] == firsts["first_digest"]), "left")
    copy = F.when(F.col("first_digest").isNull(), 16).otherwise(0)
    return joined.select("key", "part", (F.col("fails") + copy).alias("fails"), "n_words", "n_distinct")


def _steps() -> Column:
    """All orders and their steps: ``filter_order, step, bit, earlier``, the last the set of filters before it."""
    rows = []
    for order in permutations(FILTERS):
        earlier = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            rows.append({"filter_order": "".join(order), "step": step, "bit": bit, "earlier": earlier})
            earlier |= bit
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order: string, step: int, bit: int, earlier: int>>")


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source", shard_bytes: int = SHARD) -> DataFrame:
    """One row per part, order and step: ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``."""
    marks = labels.where(labels[key].isNotNull()).groupBy(labels[key].alias("of")).agg(F.max(labels["quality"]).alias("quality"), F.max(labels["toxic"]).alias("toxic"))
    judged = failures(docs, key, text, part, shard_bytes)
    marked = judged.join(marks, F.col("key") == F.col("of"), "left")
    sets = marked.groupBy("part", "fails").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"))
    parts = sets.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("sets"))  # 32 entries at most

    def total(value, where) -> Column:
        return F.aggregate("sets", F.lit(0).cast("long"), lambda s, x: s + F.when(where(x["fails"]), value(x)).otherwise(0))

    def spared(column: str) -> Column:
        """For each set of filters, what passes them all."""
        return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda m: total(lambda x: x[column], lambda f: f.bitwiseAND(m) == 0))

    # a document that fails k filters is removed by each of them in a k-th of all orders
    share = lambda f: F.lit(factorial(len(FILTERS))) / F.bit_count(f)
    by_filter = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: total(lambda x: (x["n"] * share(x["fails"])).cast("long"), lambda f: f.bitwiseAND(F.call_function("shiftleft", F.lit(1), i)) != 0))
    alone = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: total(lambda x: x["n"], lambda f: f == F.call_function("shiftleft", F.lit(1), i)))
    counted = parts.select("part", *(spared(c).alias(c) for c in ("n", "good", "toxic")), by_filter.alias("shapley"), alone.alias("alone"))
    steps = counted.select("*", F.explode(_steps()).alias("at")).select("*", "at.*")
    after = F.col("earlier").bitwiseOR(F.col("bit"))
    lost = lambda c: F.get(c, F.col("earlier")) - F.get(c, after)
    place = F.bit_count(F.col("bit") - 1)
    return steps.select(
        "part", "filter_order", "step", F.get("n", after).alias("kept"), lost("n").alias("removed"), (F.get("n", F.lit(0)) - F.get("n", F.col("bit")) - lost("n")).alias("redundant"),
        F.get("alone", place).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("shapley", place).alias("shapley"),
    )


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), m AS (
  SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1
), f AS (
  SELECT part, (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
         + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END)
         + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
         + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END) AS fails,
         coalesce(m.quality = 1, false) AS good, coalesce(m.toxic = 1, false) AS toxic
  FROM t LEFT JOIN m USING (doc_id)
), l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS name, unnest([1, 2, 4, 8, 16]) AS bit
), o AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM l a, l b, l c, l d, l e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), s AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS earlier FROM o, unnest(range(1, 6)) AS u(step)
), r AS (
  SELECT part, filter_order, step, bit, count(*) FILTER (fails & (earlier | bit) = 0) AS kept, count(*) FILTER (fails & bit <> 0 AND fails & earlier = 0) AS removed,
         count(*) FILTER (fails & bit <> 0 AND fails & earlier <> 0) AS redundant, count(*) FILTER (fails = bit) AS unique_fails,
         count(*) FILTER (fails & bit <> 0 AND fails & earlier = 0 AND good) AS good_lost, count(*) FILTER (fails & bit <> 0 AND fails & earlier = 0 AND toxic) AS toxic_lost
  FROM f, s GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""
