import random

import numpy as np
from pyspark.sql import functions as F

from emberlog.llm import mixture as M


def _targets(sizes: dict, weights=(1, 2, 3), most=3):
    """Plain water filling: cap what is above, share the rest anew, until nothing is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = {s: w for s, w in weight.items() if s not in full}
        share = {s: (total - sum(full.values())) * w / sum(rest.values()) for s, w in rest.items()}
        above = {s: most * sizes[s] for s in share if share[s] > most * sizes[s]}
        if not above:
            return full | share
        full |= above


def _quotas(votes: dict, seats: int) -> dict:
    won = dict.fromkeys(votes, 0)
    for _ in range(seats):
        best = min(votes, key=lambda k: (-votes[k] / (2 * won[k] + 1), k))
        won[best] += 1
    return won


def test_apportion_gives_highest_quotients(spark):
    for seed in range(4):
        rng = random.Random(seed)
        cells = [(g, k, rng.choice([0, 1, rng.randint(1, 9), rng.randint(1, 10_000)])) for g in "ab" for k in range(12)]
        seats = {"a": rng.randint(1, 300), "b": rng.randint(0, 20)}
        df = spark.createDataFrame([(*c, seats[c[0]]) for c in cells], "g string, k int, votes long, seats long")
        got = {(r.g, r.k): r.quota for r in M.apportion(df, "votes", "seats", "k", ["g"]).collect()}
        for g in "ab":
            want = _quotas({k: v for h, k, v in cells if h == g}, seats[g])
            assert {k: got[g, k] for k in want} == want


def test_blocks_and_copies():
    rng = np.random.default_rng(1)
    for quota, blocks in [(0, 7), (5, 7), (7, 7), (20, 7), (21, 7), (40, 7), (300, 256)]:
        sizes = rng.integers(0, 50, 200)
        taken = M.take_blocks(sizes, quota, blocks, 3)
        assert (taken <= 3 * sizes).all() and (taken >= 0).all()
        assert abs(taken.sum() - min(quota, 3 * blocks) * sizes.sum() / blocks) <= 3 * blocks
        copies = M.whole_copies(sizes, taken)
        assert copies.max() <= 3 and abs((copies * sizes).sum() - taken.sum()) <= 50
    assert M.take_blocks(np.zeros(3, np.int64), 5, 2, 1).tolist() == [0, 0, 0]


def test_mix_meets_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("size", F.lit("clash")).withColumn("key", F.lit(1))
    docs = docs.withColumn("source", F.when(F.col("source") == "src3", None).when(F.col("doc_id") % 3 == 0, "big").otherwise(F.col("source")))
    rows, again = M.mix(docs).collect(), M.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    plain = {r.doc_id: (r.source, len((r.text or "").encode().split())) for r in docs.collect()}
    assert len(rows) == len(plain)
    sizes, taken, target, copied = {}, {}, {}, {}
    for r in rows:
        source, size = plain[r.doc_id]
        assert r.size == size and r.taken <= 3 * size
        sizes[source] = sizes.get(source, 0) + size
        taken[source] = taken.get(source, 0) + r.taken
        copied[source] = copied.get(source, 0) + r.copies * size
        target[source] = r.target
    want = _targets(sizes)
    for source in sizes:
        assert abs(target[source] - want[source]) < 1e-6 * want[source] + 1e-9
        assert abs(taken[source] - want[source]) < 0.01 * want[source] + 1
        assert abs(copied[source] - want[source]) < 0.03 * want[source] + 1


def test_small_sources_stop_at_three_times(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "c " * 100, "y"), (3, None, "y"), (3, "", None), (3, "", None), (None, "q", None)], "doc_id long, text string, source string")
    rows = M.mix(docs).collect()
    assert {(r.doc_id, r.size) for r in rows} == {(1, 2), (2, 100), (3, 0), (None, 1)} and len(rows) == 6
    assert {r.doc_id: r.target for r in rows}[1] == 6.0
    mixed = M.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(r.doc_id == 1 for r in mixed.collect()) == 3


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mix(docs).collect() == [] and M.mixed_documents(docs).collect() == []
