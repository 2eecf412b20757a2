import random
from collections import Counter
from itertools import permutations

import numpy as np

from emberlog.llm import filter_audit as A


def _fails(key, text, rows):
    text = text or ""
    words = text.encode().split()
    smaller = [k for k, t, *_ in rows if (t or "") == text and k is not None and (key is None or k < key)]
    return {
        name
        for name, failed in (
            ("A", len(words) < 200), ("B", 100 * len(set(words)) < 50 * len(words)), ("C", 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text)),
            ("D", any(c in "#$%&*|" for c in text)), ("E", bool(smaller)),
        )
        if failed
    }


def _brute(rows, labels):
    marks = {}
    for key, quality, toxic in (x for x in labels if x[0] is not None):
        q, t = marks.get(key, (0, 0))
        marks[key] = (max(q, quality or 0), max(t, toxic or 0))
    out, judged = {}, [(source or "", _fails(key, text, rows), *marks.get(key, (0, 0))) for key, text, source, *_ in rows]
    for part in {x[0] for x in judged}:
        own = [x[1:] for x in judged if x[0] == part]
        shapley = dict.fromkeys(A.FILTERS, 0)
        for order in permutations(A.FILTERS):
            earlier = set()
            for step, name in enumerate(order, 1):
                gone = [x for x in own if name in x[0] and not x[0] & earlier]
                shapley[name] += len(gone)
                out[part, "".join(order), step] = [
                    sum(not x[0] & (earlier | {name}) for x in own), len(gone), sum(name in x[0] and bool(x[0] & earlier) for x in own),
                    sum(x[0] == {name} for x in own), sum(x[1] == 1 for x in gone), sum(x[2] == 1 for x in gone),
                ]
                earlier.add(name)
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def _rows(rng):
    words = [f"w{k}" for k in range(400)] + ["Été", "w x", "日本"]
    long = lambda n, few=400: " ".join(rng.choice(words[:few]) for _ in range(n))
    common = long(250)
    rows = [(k, rng.choice([common, long(250), long(230, 40), long(120), long(210) + " $", "CAPS " * 250, long(199), long(200), "\x0b\n\t", "same"]), rng.choice(["web", "web", "web", "bö", "", None]), "x", 5) for k in range(300)]
    more = [(None, common, "web"), (None, "only null", "bö"), (None, "only null", "bö"), (5000, None, "web"), (5001, "", None), (5002, "twice", "q"), (5002, "twice", "q"), (5003, "A b" * 40_000, "q")]
    return rows + [(*x, None, None) for x in more]


def test_rows_match_brute_force(spark):
    rng = random.Random(8)
    rows = _rows(rng)
    labels = [(rng.randrange(300), rng.choice([0, 1, None]), rng.choice([0, 0, 1])) for _ in range(250)] + [(None, 1, 1), (5000, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, key string, fails int").repartition(5)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for shard_bytes in (A.SHARD, 3000):
        got = A.audit(docs, table, shard_bytes=shard_bytes).collect()
        assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == _brute(rows, labels)
        assert len(got) == 600 * len({r[2] or "" for r in rows})


def test_matrix_is_global_and_whole(spark):
    rows = _rows(random.Random(3))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, key string, fails int").repartition(4)
    shards = A.document_terms(docs, shard_bytes=5000, bucket_words=50).collect()
    assert len(shards) > 8
    by_key = {k: (t or "").encode().split() for k, t, *_ in rows}
    named, got = {}, []
    for shard in shards:
        indptr, columns, counts = A.sparse_rows(shard.asDict())
        for key, a, b in zip(shard["keys"], indptr, indptr[1:], strict=False):
            if key is not None:
                assert sorted(Counter(by_key[key]).values()) == sorted(counts[a:b].tolist())
                for word, column in zip(dict.fromkeys(by_key[key]), columns[a:b].tolist(), strict=True):
                    assert named.setdefault(word, column) == column
        got += [(repr(key), int(counts[a:b].sum()), int(b - a)) for key, a, b in zip(shard["keys"], indptr, indptr[1:], strict=False)]
    assert len(set(named.values())) == len(named) == len({w for key, words in by_key.items() if key is not None for w in words})
    assert sorted(got) == sorted((repr(k), len((t or "").encode().split()), len(set((t or "").encode().split()))) for k, t, *_ in rows)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert A.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []
    assert np.diff([0]).size == 0
