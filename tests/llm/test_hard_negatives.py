import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, score string, anchor string, cell int"


def _brute(rows, every, k=5):
    kept = []
    for ident, vector, label, *_ in rows:
        if vector is None or label is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((ident, [math.floor(256 * float(np.float32(x))) for x in vector], label))
    key = lambda x: (-x[1], x[0] is None, x[0] or 0)
    out = []
    for a, (ident, vector, label) in enumerate(kept):
        if ident is None or ident % every:
            continue
        scored = [(i, sum(x * y for x, y in zip(vector, v, strict=False)), lab) for b, (i, v, lab) in enumerate(kept) if b != a]
        for positive, top, _ in sorted((x for x in scored if x[2] == label), key=key)[:k]:
            fits = sorted((x for x in scored if x[2] != label and 80 * top <= 100 * x[1] <= 100 * top), key=key)[:k]
            out += [(ident, positive, rank, i, top, s) for rank, (i, s, _) in enumerate(fits, 1)]
    return sorted(map(repr, out))


def _rows(rng, n, dims=8):
    hot = [rng.uniform(-1, 1) for _ in range(dims)]
    near = lambda: [x + rng.uniform(-0.05, 0.05) for x in hot]
    rows = [(k, rng.choice([hot, near(), near(), [rng.uniform(-1, 1) for _ in range(dims)]]), rng.choice([0, 0, 1, 2]), "s", "a", 1) for k in range(n)]
    odd = [(30, hot, 0), (30, hot, 1), (10, near(), 0), (10, hot, 0), (None, hot, 0), (None, hot, 1), (20, [], 1), (40, hot[:3], 0), (50, near() + [2.5], 0)]
    bad = [(60, None, 1), (70, hot, None), (80, [None, *hot[1:]], 1), (90, [math.nan, *hot[1:]], 1), (100, [math.inf, *hot[1:]], 1)]
    return rows + [(*x, None, None, None) for x in odd + bad]


@pytest.mark.parametrize("group", [262_144, 16])
def test_rows_match_brute_force(spark, monkeypatch, group):
    table = _rows(random.Random(11), 400)
    monkeypatch.setattr(H, "GROUP", group)
    monkeypatch.setattr(H, "SLICE", 100)
    vectors = spark.createDataFrame(table, SCHEMA).repartition(3)
    got = H.hard_negatives(vectors, F.col("vec_id") % 10 == 0).collect()
    assert sorted(repr((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score)) for r in got) == _brute(table, 10)


def test_products_are_exact_for_any_size():
    rng = np.random.default_rng(3)
    for dims, size in [(1, 3), (64, 300), (700, 90_000), (40, 2**28)]:
        a, b = rng.integers(-size, size + 1, (7, dims)), rng.integers(-size, size + 1, (9, dims))
        a[0] = b[0] = size
        primes = H.primes_for(dims * size * size)
        assert all(p % q for p in primes for q in range(2, p) if q < 40 and p != q)
        assert (H.products(H.residues(a, primes), H.residues(b, primes), primes) == a @ b.T).all()


def test_scores_beyond_float_precision(spark):
    big = [2.0**20, 2.0**20 + 1, 3.0]
    table = [(0, big, 0), (1, big, 0), (2, [big[0], big[1], 2.0], 1), (3, [2.0**31, 0.0, 0.0], 1), (4, [-x for x in big], 0)]
    got = H.hard_negatives(spark.createDataFrame(table, "vec_id long, embedding array<double>, label int"), F.col("vec_id") == 0).collect()
    assert [(r.positive_id, r.negative_id) for r in got] == [(1, 2)]
    assert got[0].negative_score == sum(int(256 * x) * int(256 * y) for x, y in zip(big, table[2][1], strict=True))


def test_empty_and_without_anchors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert H.hard_negatives(empty, F.col("vec_id") % 100 == 0).collect() == []
    assert H.hard_negatives(spark.createDataFrame(_rows(random.Random(1), 9), SCHEMA), F.col("vec_id") == 12345).collect() == []
