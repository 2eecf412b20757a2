import hashlib
import random

from emberlog.llm import exact_dedup as X


def _brute(rows):
    groups = {}
    for key, text in rows:
        plain = (text or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"})
        groups.setdefault(plain, []).append((-len(text or ""), key is None, key or 0, key))
    return sorted(
        (repr(key), repr(min(group)[3]), len(group), key == min(group)[3], hashlib.sha256(plain.encode()).hexdigest())
        for plain, group in groups.items() for *_, key in group
    )


def test_groups_match_brute_force(spark):
    rng = random.Random(5)
    texts = ["hot text", "hot  text\n", "", None, " \t\x0b", "été", "é té", "x" * 50_000, "a\u00a0b", "ab"]
    rows = [(k, rng.choice(["hot text", "hot tex t", *texts, f"own {k % 97}", f"one {k}"])) for k in range(3000)] + [(3, "ab"), (3, "ab"), (None, "ab"), (None, "never else")]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, digest string").repartition(6)
    for share, counters in [(1 / 1000, 2000), (0.05, 30), (0.3, 5)]:
        got = sorted((repr(r.doc_id), repr(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in X.exact_groups(docs, share=share, counters=counters).collect())
        assert got == _brute(rows)
    stay = X.deduplicate(docs)
    assert stay.columns == docs.columns and {r.doc_id for r in stay.collect()} == {r.doc_id for r in X.exact_groups(docs).where("kept").collect()}


def test_summaries_keep_every_frequent_key():
    rng = random.Random(1)
    stream = [rng.choice([b"a"] * 30 + [b"b"] * 10 + [bytes([k]) for k in range(60)]) for _ in range(5000)]
    counts = {}
    for at in range(0, 5000, 50):
        more = {}
        for x in stream[at : at + 50]:
            more[x] = more.get(x, 0) + 1
        counts = X.misra_gries(counts, more, 9)
    assert len(counts) <= 9
    for key in (b"a", b"b"):
        assert stream.count(key) - 500 <= counts.get(key, 0) <= stream.count(key)


def test_empty(spark):
    assert X.exact_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
