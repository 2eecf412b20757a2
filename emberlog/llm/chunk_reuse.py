"""Encode and decode texts with a word-piece BPE, encoding each content-defined chunk once.

A rolling hash over ``WINDOW`` bytes cuts texts into chunks, so equal passages of different documents fall into equal chunks whatever
stands before them. A task gathers texts up to ``BATCH`` bytes, and chunks it has not seen yet are encoded once, all their new words
in one call of the library; a chunk seen before costs one look-up of its bytes. Where a cut went through a word, the ids at the
chunks' edges are those of two halves: the join is repaired by encoding the text across it again, and the window grows, over whole
chunks if need be, until both of its ends lie between words. There both sides agree exactly with the text as a whole, because the
tokenizers served drop white space and build no token across it. Other tokenizers encode whole texts.

Chunks and words are kept by their bytes, not by hashes, in two generations of bounded size (``KEPT`` bytes each), so a task's
memory does not grow with the corpus. Chunks are shared among all documents of a task; across tasks a chunk is encoded again, which
costs less than to send its ids to every task that holds it.

Defined results: null text is the empty one and has no ids; rows that repeat a key stay apart; a null key stays null; an empty table
gives no rows; texts of any length are encoded whole; other columns play no part.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import text_of
from emberlog.llm.wordwise import tokenizer_file

#: Bytes that the rolling hash sees; a chunk ends where its top ``BITS`` bits are zero, after ``LEAST`` bytes, and after ``MOST`` in any case.
WINDOW, BITS, LEAST, MOST = 32, 9, 64, 8_192
#: Bytes of text encoded together; bytes of a generation of kept chunks, and of kept words.
BATCH, KEPT = 2 << 20, 24 << 20
ENCODED = "key long, ids array<int>, decoded string"
SPACE = b" \t\n\x0b\x0c\r"
_GEAR = np.random.default_rng(20_240_229).integers(0, 1 << 32, 256, dtype=np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte, the sum of the last ``WINDOW`` bytes' numbers, each shifted by its distance: a window doubles with each step."""
    hashed, width = _GEAR[data], 1
    while width < WINDOW:
        before = hashed.copy()
        hashed[width:] += before[:-width] << np.uint32(width)
        width *= 2
    return hashed


def cuts(data: np.ndarray) -> list[int]:
    """Where the chunks of a UTF-8 text end, its own end included; never inside a character."""
    size = len(data)
    if size <= LEAST:
        return [size] if size else []
    ends = (np.flatnonzero(rolling(data) >> np.uint32(32 - BITS) == 0) + 1).tolist()
    out, start = [], 0

    def close(end: int) -> int:
        while end < size and data[end] & 0xC0 == 0x80:
            end += 1
        if end < size:
            out.append(end)
        return end

    for end in ends:
        while end - start > MOST:
            start = close(start + MOST)
        if end - start >= LEAST:
            start = close(end)
    while size - start > MOST:
        start = close(start + MOST)
    return [*out, size]


class _Kept(dict):
    """A dictionary of two generations: what is asked for again moves to the young one; the old one goes when the young one is full."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old, self.size = most, {}, 0

    def __missing__(self, key):
        value = self.old[key]
        self.put(key, value)
        return value

    def knows(self, key) -> bool:
        return key in self or key in self.old

    def put(self, key: bytes, value) -> None:
        self[key] = value
        self.size += len(key) + 200 + len(value[0] if type(value) is tuple else value)

    def age(self) -> None:
        if self.size > self.most:
            self.old, self.size = dict(self), 0
            self.clear()


def _drops_white_space(spec: dict) -> bool:
    """Whether words between white space are encoded on their own: pieces are matched runs without white space, normalised one by one."""
    pre, model, norm = (spec.get(k) or {} for k in ("pre_tokenizer", "model", "normalizer"))
    first = (pre.get("pretokenizers") or [pre])[0]
    steps = norm.get("normalizers") or ([norm] if norm else [])
    split = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and "[^\\s" in (first.get("pattern") or {}).get("Regex", "")
    plain = all(s.get("type") in ("NFC", "Lowercase", "Replace") for s in steps) and not any(a.get("lstrip") or a.get("rstrip") or " " in a["content"] for a in spec.get("added_tokens", []))
    return bool(split and plain and model.get("type") == "BPE" and not model.get("dropout") and not spec.get("post_processor"))


class ChunkEncoder:
    """Ids of texts, and texts of ids, as the tokenizers library gives them."""

    def __init__(self, name: str, kept: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file(name))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        self.by_words = _drops_white_space(spec)
        self.joins_with_space = spec.get("decoder") is None
        self.pieces = [self.tokenizer.id_to_token(k) for k in range(self.tokenizer.get_vocab_size())]
        self.chunks, self.words = _Kept(kept), _Kept(kept)
        self.encoded = self.repaired = 0

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(found.ids, np.int32) for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: set[bytes]) -> None:
        new = [word for word in words if not self.words.knows(word)]
        for word, ids in zip(new, self._whole([word.decode() for word in new]), strict=True):
            self.words.put(word, ids.tobytes())

    def _spelt(self, chunk: bytes) -> tuple[bytes, int, int]:
        """A chunk's ids, and how many of their bytes belong to its first and its last word."""
        words = [self.words[word] for word in chunk.split()]
        return b"".join(words), len(words[0]) if words else 0, len(words[-1]) if words else 0

    def _joined(self, parts: list[bytes]) -> np.ndarray:
        """The ids of a text from those of its chunks, joins repaired."""
        out: list[bytes] = []
        window = b""  # text since the last agreed place, of which no ids are taken yet
        for part, following in zip(parts, [*parts[1:], b" "], strict=False):
            ids, head, tail = self.chunks[part]
            cut_word = part[-1] not in SPACE and following[0] not in SPACE
            if window:
                first = part.split(None, 1)[0]
                window += first
                if cut_word and len(first) == len(part):
                    continue  # no place between words in this chunk: the window grows over it
                out.append(self._again(window))
                ids, window = ids[head:], b""
                if len(first) == len(part):
                    continue
            if cut_word:
                window, ids = part.rsplit(None, 1)[-1], ids[: len(ids) - tail]
            out.append(ids)
        return np.frombuffer(b"".join(out), np.int32)

    def _again(self, text: bytes) -> bytes:
        self.repaired += 1
        self._learn({text})
        return self.words[text]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_words:
            return self._whole(texts)
        self.chunks.age()
        self.words.age()
        cut: list[list[bytes]] = []
        for text in texts:
            body = text.encode()
            ends = cuts(np.frombuffer(body, np.uint8))
            cut.append([body[a:b] for a, b in zip([0, *ends], ends, strict=False)])
        new = {part for parts in cut for part in parts if not self.chunks.knows(part)}
        self._learn({word for part in new for word in part.split()})
        for part in new:
            self.chunks.put(part, self._spelt(part))
        self.encoded += len(new)
        return [self._joined(parts) for parts in cut]

    def decode(self, ids: np.ndarray) -> str:
        if not self.joins_with_space:
            return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)
        return " ".join([self.pieces[k] for k in ids.tolist()])



def _coder(name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def flushed(coder: ChunkEncoder, keys: list, texts: list[str]) -> pa.RecordBatch:
        ids = coder.encode(texts)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), listed, pa.array([coder.decode(x) for x in ids], pa.string())], ["key", "ids", "decoded"])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ChunkEncoder(name)  # goes with the task, and what it keeps with it
        keys, texts, held = [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys.append(key)
                texts.append(text.as_py())
                held += len(texts[-1]) + 64
                if held >= BATCH:
                    yield flushed(coder, keys, texts)
                    keys, texts, held = [], [], 0
        if keys:
            yield flushed(coder, keys, texts)

    return code


def encoded(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a row of ``docs``: ``<key>, ids, decoded``."""
    rows = docs.select(docs[key].cast("long").alias("key"), text_of(docs[text]).alias("text"))
    return rows.mapInArrow(_coder(tokenizer), ENCODED).withColumnRenamed("key", key)


def digests(docs: DataFrame, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document."""
    rows = encoded(docs, tokenizer)
    decimal = F.array_join(F.transform("ids", lambda x: x.cast("string")), " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
