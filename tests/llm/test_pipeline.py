import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as C
from emberlog.llm.common import staged

SF = "/root/testdata/sf0.01"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("text", F.when(F.col("doc_id") == 3, "123 !!").when(F.col("doc_id") == 5, None).otherwise(F.col("text")))
    columns, seen = docs.columns, {}
    for name, stage in C.STAGES[:-1]:
        docs = staged(stage(spark, docs, SF), name)
        assert docs.columns == columns
        seen[name] = sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert not {3, 5} & set(seen["language"])
    assert len(seen["near_duplicates"]) < len(seen["language"]) and len(set(seen["near_duplicates"])) == len(seen["near_duplicates"])
    assert len(seen["decontamination"]) < len(seen["near_duplicates"])
    assert max(seen["mixing"].count(k) for k in set(seen["mixing"])) <= 3
    library, want, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), [], 0
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = np.array([*library.encode(r.text, add_special_tokens=False).ids, 0], "<u4")
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = C.STAGES[-1][1](spark, docs, SF)
    assert sorted((tuple(r) for r in got.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1]) == want


def test_names():
    assert [n for n, _ in C.STAGES] == ["language", "near_duplicates", "decontamination", "mixing", "tokens"]


def test_columns_with_names_of_the_operators_own(spark):
    from emberlog.llm import exact_dedup, mixture, simhash

    rows = [(1, "a b c d", "x", 0, 1, "s"), (2, "a b c d", "y", 0, 1, "s"), (None, "", None, 0, 1, "s"), (None, None, None, 0, 1, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _key int, _words int, _stays string")
    more = docs.withColumns({"_copies": F.lit(1), "_tag": F.lit(2), "component_id": F.lit(3), "fp": F.lit(4), "size": F.lit(5), "key": F.lit(6)})
    assert sorted(str(r.doc_id) for r in simhash.representatives(more).collect()) == ["1", "None", "None"]
    assert sorted(str(r.doc_id) for r in exact_dedup.deduplicate(more).collect()) == ["1", "None", "None"]
    mixed = mixture.mixed_documents(more)
    assert mixed.columns == more.columns and {r._words for r in mixed.collect()} == {1}


def test_no_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in C.STAGES:
        docs = staged(stage(spark, docs, SF), name)
        assert docs.collect() == []
