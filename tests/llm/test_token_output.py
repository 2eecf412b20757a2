import functools
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from emberlog.llm import token_output as T
from emberlog.llm import wordwise
from emberlog.llm.wordwise import encoder

ODD = [
    "", " ", "  ", "a  b", "a   b", "x \n y", "x\n \n y", "tabs\t and\u00a0more \u2003 space", "it's we'll <|endoftext|> end", "Ça été — où?  \n",
    " leading", "trailing ", "\n\nnew\n lines \n", "emoji 🎉 日本語 text", "a\x1cb \x85 c", "one  two   three    four", "word," * 50, "x" * 20_000, "1234 5 6a b7 !!! ...",
]


@functools.cache
def _library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def library_ids(text):
    return _library().encode(text, add_special_tokens=False).ids


def test_words_give_the_library_ids(spark):
    library, encode = _library(), encoder("byte_bpe_50k.json")
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(80).collect()]
    for text, ids in zip(texts, encode(pa.array(texts)), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text[:40]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab.,'s1 \n\t\r\x00\u00a0\u0120é") | st.characters(codec="utf-8")), min_size=1, max_size=6))
def test_any_texts_give_the_library_ids(texts):
    want = [library_ids(text) for text in texts]
    assert [ids.tolist() for ids in encoder("byte_bpe_50k.json")(pa.array(texts))] == want


def test_runs_and_forgetting_change_nothing(monkeypatch):
    texts = [f"{k} word{k % 7}, and\nmore {'x' * (k % 50)}" for k in range(300)] + ODD
    monkeypatch.setattr(wordwise, "RUN", 500)
    monkeypatch.setattr(wordwise, "KEPT", 2000)
    assert [ids.tolist() for ids in encoder("byte_bpe_50k.json")(pa.array(texts))] == [library_ids(text) for text in texts]


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [1, 5, 4096, 4097, 10_000])
def test_planes_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint64).astype("<u4")
    planes = T.to_planes(ids, kind)
    assert len(planes) == T.PLANES[kind]
    assert (T.from_planes(planes, n, kind) == ids).all()


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_files_hold_documents_in_key_order(spark, tmp_path, kind):
    rows = [(k, text, "x") for k, text in enumerate(ODD * 3)] + [(7, "again", "x"), (None, "no key", "x"), (500, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    path = f"{tmp_path}/tokens"
    T.write_tokens(docs, path, kind=kind, shards=3, chunk_ids=50)
    want, at, library = [], 0, _library()
    for key, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((key, at, len(ids), zlib.crc32(ids.tobytes()), ids.tolist()))
        at += len(ids)
    got = sorted((tuple(r) for r in T.read_tokens(spark, path, with_ids=True).collect()), key=lambda r: r[1])
    assert got == want
    assert [r.start for r in T.chunk_index(spark, path).orderBy("shard", "chunk").limit(1).collect()] == [0]


def test_empty_table(spark):
    assert T.round_trip(spark.createDataFrame([], "doc_id long, text string")).collect() == []
