import random

import numpy as np
import xxhash

from emberlog.llm import simhash as S


def _plain(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _brute(fps: dict):
    """Smallest key reachable over fingerprints within three bits."""
    items = sorted(fps.items(), key=lambda x: (x[0] is None, x[0] or 0))
    root = list(range(len(items)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(items)):
        for j in range(i):
            if bin(items[i][1] ^ items[j][1]).count("1") <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {key: items[find(k)][0] for k, (key, _) in enumerate(items)}


def test_fingerprints():
    texts = ["", " \n", "One", "one TWO", "a b c", "a b c d a b c", "É é x y z", "w " * 70_000, " ".join(map(str, range(60_000)))]
    for text in texts:
        assert S.fingerprint(text) == _plain(text), text[:20]
    S.CHUNK, kept = 7, S.CHUNK
    try:
        assert S.fingerprint("a b c d e f g h i j k l m n o p q r s t") == _plain("a b c d e f g h i j k l m n o p q r s t")
    finally:
        S.CHUNK = kept


def test_thresholds_find_every_near_pair():
    rng = np.random.default_rng(2)
    for parts in (2, 3, 4):
        base = rng.integers(-(2**63), 2**63, 300)
        near = np.concatenate([base ^ np.bitwise_or.reduce(np.int64(1) << rng.integers(0, 63, (300, r)), axis=1) for r in (1, 2, 3)])
        fps = np.unique(np.concatenate([base, near]))
        moments = (S._bits_of(fps).astype(float).T @ S._bits_of(fps)).astype(float)
        groups = S.group_bits(moments, len(fps), parts)
        assert sorted(b for g in groups for b in g) == list(range(64))
        plan = S.Plan(groups, [np.zeros(1 << len(bits)) for _, bits in S.pieces_of(groups)], len(fps))
        plan.shells = [S.shells(np.bincount(plan.values(fps, bits), minlength=1 << len(bits)), len(bits)) for _, bits in plan.pieces]
        limit = plan.thresholds(fps)
        assert (limit.min() >= -1) and ((limit + 1).sum(axis=1) == 4).all()
        values = np.stack([plan.values(fps, g) for g in groups], axis=1)
        for k, fp in enumerate(fps):
            close = np.bitwise_count((fps ^ fp).view(np.uint64)) <= 3
            apart = np.bitwise_count(values ^ values[k])
            assert (apart[close] <= limit[k]).any(axis=1).all()


def test_shells():
    counts = np.random.default_rng(1).integers(0, 9, 64)
    table = S.shells(counts, 6)
    for v in range(64):
        for r in range(4):
            assert table[r, v] == sum(counts[w] for w in range(64) if bin(v ^ w).count("1") == r)


def test_components_match_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    centre, fps = [rng.getrandbits(64) for _ in range(5)], {}
    for key in range(700):
        fp = rng.choice(centre) if rng.random() < 0.7 else rng.getrandbits(64)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
            fp ^= 1 << rng.randrange(64)
        fps[key] = fp
    fps[900], fps[901], fps[None] = 0, 7, fps[3]
    monkeypatch.setattr(S, "SIDE", 40)
    rows = [(k, fp - (1 << 64) if fp >> 63 else fp) for k, fp in fps.items()]
    monkeypatch.setattr(S, "fingerprints", lambda docs, key, text: spark.createDataFrame(rows, "key long, fp long"))
    got = {r.doc_id: r for r in S.near_duplicates(spark.range(1).withColumnRenamed("id", "doc_id")).collect()}
    want = _brute(fps)
    assert {k: r.component_id for k, r in got.items()} == want
    assert all(got[k].fingerprint == f"{fp:016x}" for k, fp in fps.items())


def test_documents(spark):
    base = "the quick brown fox jumps over the lazy dog " * 30
    texts = {1: base, 2: base, 3: base.upper(), 4: None, 5: "", 6: " \t", 7: "other", 8: "words of another kind entirely", 9: base * 40}
    docs = spark.createDataFrame([(k, t, "fp") for k, t in texts.items()] + [(2, base, "x"), (None, "", "y")], "doc_id long, text string, fp string")
    got = S.near_duplicates(docs).collect()
    want = _brute({k: _plain(t) for k, t in texts.items()})
    assert len(got) == 11
    for r in got:
        if r.doc_id is not None:
            assert (r.fingerprint, r.component_id) == (f"{_plain(texts[r.doc_id]):016x}", want[r.doc_id])
    stay = S.representatives(docs)
    assert stay.columns == docs.columns and {r.doc_id for r in stay.collect()} == set(want.values())


def test_registered_query(spark):
    from emberlog.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op1_simhash"](spark, "/root/testdata/sf0.001").collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    fps = {k: _plain(t) for k, t in texts.items()}
    want = _brute(fps)
    assert {k: (r.fingerprint, r.component_id) for k, r in got.items()} == {k: (f"{fps[k]:016x}", want[k]) for k in texts}


def test_empty(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
