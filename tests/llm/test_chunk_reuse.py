import hashlib
import random

import numpy as np
import pytest

from emberlog.llm import chunk_reuse as C
from emberlog.llm.wordwise import tokenizer_file

ALPHABET = ["ab", "Ab", "don't", "é", "é", "́", "日本語", "٣", "12", "<|endoftext|>", "<|endof", "text|>", "ﬁ", "İ", "Σ", "'ll", "...", "$$", "\x1c", "\x85", " ", "\xa0", "🎉", "ß"]
GAPS = ["", "", " ", " ", " ", "\n", "\t", "  ", "\r\n", "\x0b", "\x0c"]


def _text(rng, n):
    return "".join(rng.choice(ALPHABET) + rng.choice(GAPS) for _ in range(n))


def _library(name="word_bpe_49k.json"):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file(name))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@pytest.mark.parametrize(("bits", "least", "most"), [(9, 64, 8192), (2, 1, 9), (3, 5, 40)])
def test_ids_and_texts_are_the_library_s(monkeypatch, bits, least, most):
    for name, value in (("BITS", bits), ("LEAST", least), ("MOST", most)):
        monkeypatch.setattr(C, name, value)
    rng, library = random.Random(bits), _library()
    passage = _text(rng, 400)
    texts = ["", " ", "\n\n", "a", "日" * 30_000, "x" * 50_000, "<|endoftext|>" * 900, "́" * 500, passage] + [_text(rng, rng.randrange(300)) + passage * rng.randrange(2) + _text(rng, 30) for _ in range(150)]
    coder = C.ChunkEncoder("word_bpe_49k.json", kept=50_000)
    assert coder.by_words
    for at in range(0, len(texts), 20):
        for text, ids in zip(texts[at : at + 20], coder.encode(texts[at : at + 20]), strict=True):
            expected = library.encode(text, add_special_tokens=False).ids
            assert ids.tolist() == expected, text[:80]
            assert coder.decode(ids) == library.decode(expected, skip_special_tokens=False)
    assert coder.repaired


def test_shared_passages_are_encoded_once():
    rng = random.Random(4)
    passage = " ".join(rng.choice(ALPHABET) + str(rng.random()) for _ in range(2000))
    coder = C.ChunkEncoder("word_bpe_49k.json")
    coder.encode([passage])
    once = coder.encoded
    coder.encode([f"{k} other start {passage} and end {k}" for k in range(50)])
    assert coder.encoded - once < 50 * 6 < 50 * once


def test_cuts_follow_content_and_keep_characters_whole():
    rng = np.random.default_rng(2)
    body = rng.integers(97, 123, 40_000, dtype=np.uint8)
    ends = C.cuts(body)
    assert ends[-1] == len(body) and max(np.diff([0, *ends])) <= C.MOST + 3
    moved = [e - 1000 for e in C.cuts(np.concatenate([rng.integers(97, 123, 1000, dtype=np.uint8), body]))]
    assert len(set(ends) & set(moved)) > 0.8 * len(ends)
    h = C.rolling(body)
    slow = sum(int(C._GEAR[body[5000 - k]]) << k for k in range(C.WINDOW)) % (1 << 32)
    assert int(h[5000]) == slow
    for text in ("日本" * 9000, "é" * 20_000):
        data = text.encode()
        for a, b in zip([0, *C.cuts(np.frombuffer(data, np.uint8))], C.cuts(np.frombuffer(data, np.uint8)), strict=False):
            data[a:b].decode()


def test_another_tokenizer_encodes_whole_texts():
    coder = C.ChunkEncoder("byte_bpe_50k.json")
    assert not coder.by_words
    text = _text(random.Random(1), 300)
    ids = coder.encode([text])[0]
    assert ids.tolist() == _library("byte_bpe_50k.json").encode(text, add_special_tokens=False).ids and coder.decode(ids) == text


def test_query_digests(spark):
    rng, library = random.Random(9), _library()
    texts = [None, "", "same text", "same text", "w " * 300_000] + [_text(rng, 200) for _ in range(40)]
    rows = [(None if k == 7 else k // 2, text, "ids", "x") for k, text in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, key string").repartition(3)
    got = sorted((repr(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in C.digests(docs).collect())

    def of(text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    assert got == sorted((repr(k), *of(text)) for k, text, *_ in rows)
    assert C.digests(docs.limit(0)).collect() == []
