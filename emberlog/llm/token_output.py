"""Token ids in a binary format: byte or bit planes of fixed-size id blocks, compressed, with a chunk index.

Documents are dealt by ranges of their key and encoded in that order, an end id after each. A *shard* is one range; it is a run of
*chunks*, each the ids of whole documents, ``CHUNK`` ids or more. The ids of a chunk are cut into blocks of ``BLOCK`` ids (the last
one padded with zeros); each block is transposed into 4 byte planes or 32 bit planes, and equal planes of all blocks are compressed
together with zstandard. Spark's own writer stores a chunk as one record, so a retried or lost task never leaves half a shard; the
small columns of the record (first and last key, documents, ids) are the chunk index, read without touching the planes.

Defined results: null text is the empty one and gives the end id alone; null keys come first; rows that repeat a key stay apart, in
order of their text; an empty table gives no chunks; other columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.llm.common import shared_folder, shuffle_parts, text_of
from emberlog.llm.wordwise import encoder

BLOCK, CHUNK = 4096, 65_536
#: Parts of the id that planes are made of.
PLANES = {"byte": 4, "bit": 32}
SCHEMA = "shard int, chunk int, first_key long, last_key long, n_docs int, n_ids long, kind string, keys binary, lengths binary, planes array<binary>"
_ARROW = pa.schema(
    [("shard", pa.int32()), ("chunk", pa.int32()), ("first_key", pa.int64()), ("last_key", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64()),
     ("kind", pa.string()), ("keys", pa.binary()), ("lengths", pa.binary()), ("planes", pa.list_(pa.binary()))]
)


def to_planes(ids: np.ndarray, kind: str = "byte", block: int = BLOCK) -> list[bytes]:
    """The compressed planes of ``ids``; plane p of all blocks is one zstandard frame."""
    padded = np.zeros(-(-len(ids) // block) * block, "<u4")
    padded[: len(ids)] = ids
    parts = padded.view(np.uint8).reshape(-1, block, 4)
    if kind == "bit":
        bits = np.unpackbits(parts, axis=2, bitorder="little")
        planes = np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")
    else:
        planes = parts.transpose(2, 0, 1)
    pack = zstandard.ZstdCompressor(level=3)
    return [pack.compress(np.ascontiguousarray(plane).tobytes()) for plane in planes]


def from_planes(planes: list[bytes], n_ids: int, kind: str = "byte", block: int = BLOCK) -> np.ndarray:
    """The ids that ``to_planes`` was given."""
    unpack, blocks = zstandard.ZstdDecompressor(), -(-n_ids // block)
    raw = np.stack([np.frombuffer(unpack.decompress(plane), np.uint8).reshape(blocks, -1) for plane in planes])
    if kind == "bit":
        bits = np.unpackbits(raw, axis=2, bitorder="little").transpose(1, 2, 0)
        parts = np.packbits(bits, axis=2, bitorder="little")
    else:
        parts = raw.transpose(1, 2, 0)
    return np.ascontiguousarray(parts).reshape(-1).view("<u4")[:n_ids]


def _record(shard: int, chunk: int, keys: list[int | None], ids: list[np.ndarray], kind: str) -> pa.RecordBatch:
    lengths, flat, pack = np.array([len(x) for x in ids], "<u4"), np.concatenate(ids), zstandard.ZstdCompressor(level=3)
    held = np.array([[k is not None, k or 0] for k in keys], "<i8")
    values = (shard, chunk, keys[0], keys[-1], len(keys), len(flat), kind, pack.compress(held.tobytes()), pack.compress(lengths.tobytes()), to_planes(flat, kind))
    return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(values, _ARROW, strict=True)], schema=_ARROW)


def _writer(tokenizer: str, end_id: int, kind: str, chunk_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, chunk, end, held = TaskContext.get().partitionId(), 0, np.array([end_id], "<u4"), 0
        encode = encoder(tokenizer)
        keys: list[int | None] = []
        ids: list[np.ndarray] = []
        for batch in batches:
            for key, found in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                keys.append(key)
                ids.append(np.concatenate([found, end]))
                held += len(ids[-1])
                if held >= chunk_ids:
                    yield _record(shard, chunk, keys, ids, kind)
                    chunk, keys, ids, held = chunk + 1, [], [], 0
        if keys:
            yield _record(shard, chunk, keys, ids, kind)

    return write


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, kind: str = "byte", key: str = "doc_id", text: str = "text", shards: int | None = None, chunk_ids: int = CHUNK
) -> None:
    """Encode every text and write the shards to ``path``, a folder of any store that Spark writes to."""
    rows = docs.select(docs[key].cast("long").alias("key"), text_of(docs[text]).alias("text"))
    dealt = rows.repartitionByRange(shards or shuffle_parts(docs.sparkSession), "key").sortWithinPartitions("key", "text")
    dealt.mapInArrow(_writer(tokenizer, end_id, kind, chunk_ids), SCHEMA).write.option("compression", "uncompressed").parquet(path)


def chunk_index(spark: SparkSession, path: str) -> DataFrame:
    """``shard, chunk, start`` and the index columns of every chunk; start counts the ids of all chunks before it.

    The unpartitioned window sees one row a shard; chunks are summed within their shard.
    """
    chunks = spark.read.schema(SCHEMA).parquet(path).select("shard", "chunk", "first_key", "last_key", "n_docs", "n_ids")
    shards = chunks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = shards.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("base"))
    within = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("chunk")) - F.col("n_ids")
    return chunks.withColumn("within", within).join(before, "shard").withColumn("start", F.col("base") + F.col("within")).drop("base", "within")


def _documents(batch_rows: dict) -> Iterator[tuple[int | None, np.ndarray, int]]:
    unpack = zstandard.ZstdDecompressor()
    ids = from_planes(batch_rows["planes"], batch_rows["n_ids"], batch_rows["kind"])
    keys = np.frombuffer(unpack.decompress(batch_rows["keys"]), "<i8").reshape(-1, 2)
    at = 0
    for (there, key), n in zip(keys.tolist(), np.frombuffer(unpack.decompress(batch_rows["lengths"]), "<u4").tolist(), strict=True):
        yield (key if there else None), ids[at : at + n], at
        at += n


def _reader(with_ids: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in ("shard", "chunk", "n_ids", "kind", "keys", "lengths", "planes")}
                out = [(key, row["shard"], row["chunk"], at, len(ids), zlib.crc32(ids.tobytes()), ids if with_ids else None) for key, ids, at in _documents(row)]
                names = ("key", "shard", "chunk", "at", "n_tokens", "ids_crc32")
                types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                columns = [pa.array([x[i] for x in out], t) for i, t in enumerate(types)]
                if with_ids:
                    columns.append(pa.array([x[6] for x in out], pa.list_(pa.int32())))
                    names += ("ids",)
                yield pa.RecordBatch.from_arrays(columns, list(names))

    return read


def read_tokens(spark: SparkSession, path: str, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """The documents of the files at ``path``: ``<key>, start, n_tokens, ids_crc32`` and, on demand, their ids."""
    schema = "key long, shard int, chunk int, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    rows = spark.read.schema(SCHEMA).parquet(path).mapInArrow(_reader(with_ids), schema)
    index = chunk_index(spark, path).select("shard", "chunk", F.col("start").alias("base"))
    found = rows.join(index, ["shard", "chunk"])
    return found.select(F.col("key").alias(key), (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def round_trip(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """Write all documents to the shared folder and report what the files hold."""
    import uuid

    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer)
    return read_tokens(spark, path)
