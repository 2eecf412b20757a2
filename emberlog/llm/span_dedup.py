"""Removal of repeated byte spans by suffix arrays.

A byte goes where a string of 50 bytes covers it that also starts in a document with a smaller key. The work has four steps.

1. *Per shard* (some megabytes of neighbouring documents) a suffix array of 64 bytes, by Larsson-Sadakane refinement, and common
   prefixes up to 50 bytes, by direct comparison, show every window of 50 bytes that repeats within the shard. Only the windows left go on.
2. *Across shards* windows meet by anchors, the grams with the least hash in each window: equal windows have equal anchors, one for
   about 20 bytes. A shard sorts its anchors, cuts the sorted run into ranges of the hash by binary search and sends each range to
   its task, where the runs are merged. An anchor whose whole surroundings also occur under a smaller key is settled: all windows
   around it repeat. Where surroundings differ, the edge of a repeat may lie inside; the anchor is returned to its document.
3. The windows around returned anchors are hashed and merged across shards in the same way, window by window.
4. Each document joins what was found for it.

A suffix array of everything, merged suffix by suffix, would move tens of bytes for each byte of text; step 2 moves about one.
Window hashes have 80 bits, those of the surroundings 64 besides the anchor's 48: many documents that share a line amid different
text are told apart by the surroundings' hash alone. Nothing is collected; there is a task for some 32 MB of text, which merges range by range,
and a shard sends what it repeats within itself only once. Equal anchors amid different text meet in one task, about 40 bytes for each.

Defined results: null text counts as empty; a null key is larger than all others; rows that repeat a key do not remove each other's
bytes and are told apart by a 64-bit hash of the text; texts shorter than 50 bytes lose nothing; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm import suffixes as S
from emberlog.llm.common import shuffle_parts, staged, text_of

#: Bytes of text in a shard, and in one whose unclear windows are sent; bytes of all texts for which there is a task that merges, and
#: the ranges of hashes that it merges one after the other.
SHARD, WINDOW_SHARD, TASK, RANGES = 4_000_000, 16_000_000, 32_000_000, 4
#: Texts that the dictionary of the exchange is trained on.
DICTIONARY_TEXTS = 2000
LAST = (1 << 63) - 1
#: Columns of a sent item: hash, hash of the surroundings and of their two parts, key, tag of the row, place in the document.
ITEM = np.dtype([("h", "<u8"), ("c", "<u8"), ("a", "<u2"), ("b", "<u2"), ("ord", "<i8"), ("tag", "<u8"), ("at", "<u4")])
#: Bits of a hash that are sent; the ranges are cut by its upper ones.
SENT_BITS = 48


def _pack(items: np.ndarray) -> bytes:
    """The columns' byte planes, compressed; sorted hashes share their upper bytes."""
    planes = [np.ascontiguousarray(items[name]).view(np.uint8).reshape(len(items), -1).T.tobytes() for name in items.dtype.names]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(data: bytes, kind: np.dtype = ITEM) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, at = len(raw) // kind.itemsize, 0
    items = np.empty(n, kind)
    for name in kind.names:
        size = kind[name].itemsize
        items[name] = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).reshape(-1).view(kind[name])
        at += n * size
    return items


def _ranges(items: np.ndarray, ranges: int) -> Iterator[tuple[int, bytes]]:
    """Sorted items cut at the bounds of the hash ranges by binary search."""
    items = items[np.argsort(items["h"], kind="stable")]
    bounds = (np.arange(1, ranges, dtype=np.uint64) * np.uint64(((1 << 64) - 1) // ranges)).astype(np.uint64)
    cuts = np.concatenate([[0], np.searchsorted(items["h"], bounds), [len(items)]])
    for k in range(ranges):
        if cuts[k + 1] > cuts[k]:
            yield k, _pack(items[cuts[k] : cuts[k + 1]])


def _sent(found: list[tuple[int, bytes]], kind: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r for r, _ in found], pa.int32()), pa.array([kind] * len(found)), pa.array([b for _, b in found], pa.binary())], ["range", "kind", "items"])


SENT = "range int, kind string, items binary"


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Keys, tags and texts of neighbouring rows."""
    ords, tags, texts, size = [], [], [], 0
    for batch in batches:
        for ord_, tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            ords.append(ord_), tags.append(tag), texts.append(text.as_py().encode("utf-8", "surrogatepass"))
            size += len(texts[-1])
            if size >= SHARD:
                yield np.array(ords, np.int64), np.array(tags, np.int64).view(np.uint64), texts
                ords, tags, texts, size = [], [], [], 0
    if texts:
        yield np.array(ords, np.int64), np.array(tags, np.int64).view(np.uint64), texts


def _items(hashes: tuple, ords: np.ndarray, tags: np.ndarray, starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    owner, out = S.owners(starts, at), np.empty(len(at), ITEM)
    for name, values in zip("hcab", hashes, strict=True):
        out[name] = values
    out["h"] &= np.uint64((1 << 64) - (1 << (64 - SENT_BITS)))
    out["ord"], out["tag"], out["at"] = ords[owner], tags[owner], at - starts[owner]
    return out


def _anchor_sender(ranges: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ords, tags, texts in _shards(batches):
            buffer, starts, ends = S.join_texts(texts)
            wanted = S.window_starts(starts, ends, len(buffer))
            repeated = S.repeated_windows(buffer, starts, wanted, ords)
            wanted[repeated] = False
            at, h = S.anchors(buffer, wanted)
            yield _sent(list(_ranges(_items((h, *S.contexts(buffer, starts, ends, at)), ords, tags, starts, at), ranges)), "anchor")
            # what repeats within the shard is settled: runs of windows go along as they are, dealt over the ranges
            repeated = np.sort(repeated)
            if len(repeated):
                first = np.flatnonzero(np.append(True, np.diff(repeated) > 1))
                length = np.diff(np.append(first, len(repeated)))
                runs = _items((length.astype(np.uint64) << np.uint64(64 - SENT_BITS), 0, 0, 0), ords, tags, starts, repeated[first])
                yield _sent([(int(ords[0]) % ranges, _pack(runs))], "settled")

    return send


#: Columns of a found span: key, tag of the row, begin and end in the document.
SPAN_ITEM = np.dtype([("ord", "<i8"), ("tag", "<u8"), ("begin", "<i4"), ("end", "<i4")])
FOUND = "bucket int, kind string, spans binary"


def _spans(items: np.ndarray, before: int, after: np.ndarray | int) -> np.ndarray:
    spans = np.empty(len(items), SPAN_ITEM)
    spans["ord"], spans["tag"] = items["ord"], items["tag"]
    spans["begin"], spans["end"] = items["at"].astype(np.int64) - before, items["at"].astype(np.int64) + after
    return spans


class Found:
    """Spans of one kind, packed by buckets of documents: a row a bucket for each ``MOST`` spans, however many documents and ranges."""

    MOST = 500_000

    def __init__(self, kind: str, buckets: int):
        self.kind, self.buckets = kind, buckets
        self.held: list[np.ndarray] = []

    def add(self, spans: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(spans)
        if sum(map(len, self.held)) >= self.MOST:
            yield from self.sent()

    def sent(self) -> Iterator[pa.RecordBatch]:
        spans = np.concatenate([np.empty(0, SPAN_ITEM), *self.held])
        self.held.clear()
        if not len(spans):
            return
        bucket = (S.mixed(spans["ord"].view(np.uint64) ^ spans["tag"]) % np.uint64(self.buckets)).astype(np.int64)
        by = np.lexsort((spans["begin"], spans["ord"], bucket))
        spans, bucket = spans[by], bucket[by]
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        blobs = [_pack(part) for part in np.split(spans, first[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), pa.array([self.kind] * len(blobs)), pa.array(blobs, pa.binary())], ["bucket", "kind", "spans"])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a document with its spans, those that touch joined."""
    held = [_unpack(data, SPAN_ITEM) for batch in batches for data in batch.column(2).to_pylist()]
    if not held:
        return
    spans = np.concatenate(held)
    spans = spans[np.lexsort((spans["begin"], spans["tag"], spans["ord"]))]
    new = np.append(True, (spans["ord"][1:] != spans["ord"][:-1]) | (spans["tag"][1:] != spans["tag"][:-1]))
    document = np.cumsum(new) - 1
    # ends so far within a document, by a running maximum over ends lifted by the document's number
    lift = document * np.int64(1 << 32)
    reach = np.maximum.accumulate(spans["end"].astype(np.int64) + lift) - lift
    apart = new | np.append(True, spans["begin"][1:] > reach[:-1])
    first = np.flatnonzero(apart)
    last = np.append(first[1:], len(spans)) - 1
    runs = np.stack([spans["begin"][first].astype("<i4"), reach[last].astype("<i4")], axis=1)
    heads = np.flatnonzero(new[first])
    ends = np.append(heads[1:], len(first))
    for at in range(0, len(heads), 5000):
        some = slice(at, at + 5000)
        own = first[heads[some]]
        blobs = [runs[a:b].tobytes() for a, b in zip(heads[some], ends[some], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(spans["ord"][own]), pa.array(spans["tag"][own].astype(np.int64)), pa.array(blobs, pa.binary())], ["ord", "tag", "spans"])


def _merge(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Merge the sorted runs of each range, one range after the other: their rows are neighbours."""
    held: dict[str, list[bytes]] = {"anchor": [], "window": []}
    settled, unclear = Found("settled", buckets), Found("unclear", buckets)
    current = None
    for batch in batches:
        for at, kind, data in zip(*batch.columns, strict=True):
            if at.as_py() != current:
                yield from _merge_range(held, settled, unclear)
                current = at.as_py()
            if kind.as_py() == "settled":
                runs = _unpack(data.as_py())
                yield from settled.add(_spans(runs, 0, (runs["h"] >> np.uint64(64 - SENT_BITS)).astype(np.int64) + S.SPAN - 1))
            else:
                held[kind.as_py()].append(data.as_py())
    yield from _merge_range(held, settled, unclear)
    yield from settled.sent()
    yield from unclear.sent()


def _merge_range(held: dict[str, list[bytes]], settled: Found, unclear: Found) -> Iterator[pa.RecordBatch]:
    """Anchors: settled spans and, where surroundings differ, anchors to return. Windows: settled spans."""
    for kind in ("anchor", "window"):
        if not held[kind]:
            continue
        items = np.concatenate([_unpack(data) for data in held[kind]])
        held[kind].clear()
        items = items[np.lexsort((items["ord"], items["c"], items["b"], items["a"], items["h"]))]
        first = np.flatnonzero(_new(items, "habc"))
        least = np.repeat(items["ord"][first], np.diff(np.append(first, len(items))))
        later = items["ord"] > least
        yield from settled.add(_spans(items[later], S.LEFT if kind == "anchor" else 0, S.SPAN))
        if kind == "anchor":
            # an unclear span is one of window starts: half of the windows around an anchor hold part a whole, the others part b: they can repeat only where that does
            items = items[~later]
            yield from unclear.add(_spans(items[_shared(items, "ha")], S.HALF, 1))
            items = items[np.lexsort((items["b"], items["h"]))]
            yield from unclear.add(_spans(items[_shared(items, "hb")], S.LEFT, 1 - S.HALF))


def _new(items: np.ndarray, names: str) -> np.ndarray:
    """Where sorted items differ from the one before in one of the columns."""
    differ = np.zeros(max(0, len(items) - 1), bool)
    for name in names:
        differ |= items[name][1:] != items[name][:-1]
    return np.append(np.ones(min(1, len(items)), bool), differ)


def _shared(items: np.ndarray, names: str) -> np.ndarray:
    """Items whose columns equal those of an item of another key."""
    first = np.flatnonzero(_new(items, names))
    if not len(first):
        return np.zeros(0, bool)
    size = np.diff(np.append(first, len(items)))
    return np.repeat(np.minimum.reduceat(items["ord"], first) < np.maximum.reduceat(items["ord"], first), size)


def _window_sender(ranges: int, packer: Packer):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ords, tags, texts, marks, size = [], [], [], [], 0
        unpack = packer.unpacker()

        def shard() -> Iterator[pa.RecordBatch]:
            buffer, starts, ends = S.join_texts(texts)
            near = np.zeros(len(buffer), bool)
            for start, end, spans in zip(starts, ends, marks, strict=True):
                near[start:end] = S.covered(end - start, spans[:, 0], spans[:, 1])
            at = np.flatnonzero(near & S.window_starts(starts, ends, len(buffer)))
            h, more = S.span_hash(buffer, at, S.SPAN, 17), S.span_hash(buffer, at, S.SPAN, 23)
            hashes = (h, more >> np.uint64(32), 0, 0)
            items = _items(hashes, np.array(ords, np.int64), np.array(tags, np.int64).view(np.uint64), starts, at)
            items = items[np.lexsort((items["ord"], items["c"], items["h"]))]
            first = np.flatnonzero(_new(items, "hc"))
            later = items["ord"] > np.repeat(items["ord"][first], np.diff(np.append(first, len(items))))
            yield _sent(list(_ranges(items[~later], ranges)), "window")
            if later.any():  # a smaller key holds the window in this shard: settled, as a run of one
                own = items[later]
                own["h"] = np.uint64(1 << (64 - SENT_BITS))
                yield _sent([(int(ords[0]) % ranges, _pack(own))], "settled")

        for batch in batches:
            for ord_, tag, packed, blob in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                ords.append(ord_), tags.append(tag), texts.append(unpack(packed))
                marks.append(np.frombuffer(blob, "<i4").reshape(-1, 2))
                size += len(texts[-1])
                if size >= WINDOW_SHARD:
                    yield from shard()
                    ords, tags, texts, marks, size = [], [], [], [], 0
        if texts:
            yield from shard()

    return send


class Packer:
    """Short texts are compressed with a dictionary of what sampled texts have in common."""

    def __init__(self, dictionary: bytes):
        self.dictionary = dictionary

    def _held(self) -> dict:
        return {"dict_data": zstandard.ZstdCompressionDict(self.dictionary)} if self.dictionary else {}

    def pack(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3, **self._held())
        for batch in batches:
            packed = [packer.compress(text.as_py().encode("utf-8", "surrogatepass")) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary()), batch.column(3)], ["ord", "tag", "packed", "key"])

    def unpacker(self):
        return zstandard.ZstdDecompressor(**self._held()).decompress


def packer_for(docs: DataFrame, text: str) -> Packer:
    """A dictionary of 64 KB from the beginnings of some texts: it only makes the exchange smaller."""
    some = docs.select(F.substring(text_of(docs[text]), 1, 2000).alias("t")).where(F.length("t") > 100).limit(DICTIONARY_TEXTS).collect()
    try:
        return Packer(zstandard.train_dictionary(65_536, [r.t.encode("utf-8", "surrogatepass") for r in some]).as_bytes())
    except zstandard.ZstdError:  # too few texts to train on
        return Packer(b"")


def removed_mask(n: int, blob: bytes | None) -> np.ndarray:
    spans = np.frombuffer(blob or b"", "<i4").reshape(-1, 2)
    return S.covered(n, spans[:, 0], spans[:, 1])


def _finisher(packer: Packer):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = packer.unpacker()
        for batch in batches:
            rows = []
            for packed, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = np.frombuffer(unpack(packed), np.uint8)
                gone = removed_mask(len(text), blob)
                edge = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
                begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                rows.append((len(text), int(gone.sum()), len(begin), hashlib.sha256(text[~gone].tobytes()).hexdigest(), np.stack([begin, end], axis=1).tolist()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return finish


def _keyed(docs: DataFrame, key: str, text: str) -> tuple[Column, Column, Column]:
    body = text_of(docs[text])
    return F.coalesce(docs[key].cast("long"), F.lit(LAST)).alias("ord"), F.xxhash64(body).alias("tag"), body.alias("text")


def repeated_spans(docs: DataFrame, packer: Packer, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``ord, tag, spans``: what was found for each document, as pairs of begin and end."""
    rows = docs.select(*_keyed(docs, key, text))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_parts(docs.sparkSession), -(-size // TASK))
    ranges = RANGES * parts

    def merged(sent: DataFrame, name: str) -> DataFrame:
        return staged(sent.repartitionById(parts, "range").sortWithinPartitions("range").mapInArrow(lambda batches: _merge(batches, parts), FOUND), name)

    def gathered(found: DataFrame) -> DataFrame:
        return found.repartitionById(parts, "bucket").mapInArrow(_gather, "ord long, tag long, spans binary")

    first = merged(rows.mapInArrow(_anchor_sender(ranges), SENT), "anchors")
    unclear = gathered(first.where(F.col("kind") == "unclear")).withColumnRenamed("spans", "marks")
    asked = packed_texts(docs, packer, key, text).join(unclear, ["ord", "tag"]).select("ord", "tag", "packed", "marks")
    second = merged(asked.mapInArrow(_window_sender(ranges, packer), SENT), "windows")
    return gathered(first.where(F.col("kind") == "settled").unionByName(second))


def packed_texts(docs: DataFrame, packer: Packer, key: str, text: str) -> DataFrame:
    """The texts, compressed for the exchange by document."""
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(*_keyed(docs, key, text), docs[key].alias("key")).mapInArrow(packer.pack, f"ord long, tag long, packed binary, key {kind}")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``<key>, n_bytes, n_removed, n_spans, kept_sha256, spans``; spans are the removed runs, begin and end."""
    packer = packer_for(docs, text)
    found = repeated_spans(docs, packer, key, text).withColumnRenamed("spans", "found")
    kind = docs.schema[key].dataType.simpleString()
    joined = packed_texts(docs, packer, key, text).join(found, ["ord", "tag"], "left").select("key", "packed", "found")
    schema = f"key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>"
    return joined.mapInArrow(_finisher(packer), schema).withColumnRenamed("key", key)


def removals(docs: DataFrame) -> DataFrame:
    """The registered query."""
    return remove_repeats(docs).drop("spans")


ORACLE = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, unnest(range(0, length(x) // 2 - 49)) AS p, x FROM t WHERE length(x) >= 100),
g AS (SELECT doc_id, p, substr(x, 2 * p + 1, 100) AS s FROM w),
f AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS first FROM g),
r AS (SELECT doc_id, p, p - coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -100) AS step FROM f WHERE first < doc_id),
n AS (SELECT doc_id, p, sum(CASE WHEN step > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM r),
s AS (SELECT doc_id, run, min(p) AS b, max(p) + 50 AS e FROM n GROUP BY 1, 2),
k AS (SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS keep_from FROM s),
parts AS (
  SELECT k.doc_id, sum(e - b) AS n_removed, count(*) AS n_spans, max(e) AS last_end,
         string_agg(substr(t.x, 2 * keep_from + 1, 2 * (b - keep_from)), '' ORDER BY b) AS head
  FROM k JOIN t USING (doc_id) GROUP BY 1
)
SELECT t.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last_end, 0) + 1))) AS kept_sha256
FROM t LEFT JOIN parts USING (doc_id)
"""
