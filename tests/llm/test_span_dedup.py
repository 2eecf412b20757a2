import hashlib
import random

import numpy as np
import pytest

from emberlog.llm import span_dedup as P
from emberlog.llm import suffixes as S


def _brute(rows):
    first, out = {}, []
    for key, text in rows:
        data = (text or "").encode()
        for p in range(len(data) - 49):
            w = data[p : p + 50]
            first[w] = min(first.get(w, 1 << 62), 1 << 61 if key is None else key)
    for key, text in rows:
        data, gone = (text or "").encode(), np.zeros(len((text or "").encode()), bool)
        for p in range(len(data) - 49):
            if first[data[p : p + 50]] < (1 << 61 if key is None else key):
                gone[p : p + 50] = True
        left = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((repr(key), len(data), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out)


def _rows(seed, n=60):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "délta", "of", "the", "日本", "x"]
    line = " ".join(rng.choices(words, k=14))
    texts = []
    for _ in range(n):
        parts = [" ".join(rng.choices(words, k=rng.randint(1, 30)))]
        for _ in range(rng.randint(0, 3)):
            kind = rng.random()
            if kind < 0.4 and texts:
                old = rng.choice(texts)
                a = rng.randrange(len(old))
                parts.append(old[a : a + rng.randint(20, 160)])
            elif kind < 0.7:
                parts.append(line)
            elif kind < 0.8:
                parts.append(rng.choice(["a", "ab", "\x00", "der "]) * rng.randint(30, 200))
            parts.append(" ".join(rng.choices(words, k=rng.randint(0, 25))))
        texts.append(rng.choice(["", " ", "\n"]).join(parts))
    rows = [(k * 3 % 101, t) for k, t in enumerate(texts)] + [(500, texts[5]), (500, texts[5]), (500, texts[7]), (None, texts[8]), (None, "end " * 40), (501, None), (502, ""), (503, "short")]
    return rows


def test_spans_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(P, "SHARD", 3000)
    for seed in range(3):
        rows = _rows(seed)
        docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, key string").repartition(3)
        got = sorted((repr(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in P.removals(docs).collect())
        assert got == _brute(rows)


def test_suffix_order_and_prefixes():
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab", k=rng.randint(60, 300))).encode() for _ in range(6)]
    texts += [texts[0][10:150] + b"zz", b"a" * 200]
    buffer, starts, ends = S.join_texts(texts)
    valid = S.window_starts(starts, ends, len(buffer))
    order = S.suffix_order(buffer, np.flatnonzero(valid))
    data = buffer.tobytes()
    assert [data[p : p + 64] for p in order] == sorted(data[p : p + 64] for p in order)
    shared = S.common_prefixes(buffer, order)
    for k in range(1, len(order)):
        a, b = data[order[k - 1] : order[k - 1] + 50], data[order[k] : order[k] + 50]
        want = next((n for n in range(min(len(a), len(b))) if a[n] != b[n]), min(len(a), len(b)))
        assert shared[k] == want
    seen = {}
    for p in np.flatnonzero(valid):
        seen.setdefault(data[p : p + 50], set()).add(int(S.owners(starts, np.array([p]))[0]))
    want = {int(p) for p in np.flatnonzero(valid) if min(seen[data[p : p + 50]]) < S.owners(starts, np.array([p]))[0]}
    assert set(S.repeated_windows(buffer, starts, valid, np.arange(len(texts))).tolist()) == want


def test_packing():
    rng = np.random.default_rng(1)
    items = np.zeros(1000, P.ITEM)
    for name in P.ITEM.names:
        items[name] = rng.integers(0, 60_000, 1000)
    assert (P._unpack(P._pack(items)) == items).all()


def test_long_text_and_empty(spark):
    long = " ".join(str(k * 7919 % 100_003) for k in range(300_000))
    docs = spark.createDataFrame([(1, long), (2, "new start " + long[500:900_000])], "doc_id long, text string")
    rows = {r.doc_id: r for r in P.remove_repeats(docs).collect()}
    assert rows[1].n_removed == 0 and rows[2].spans == [[10, 10 + 899_500]]
    assert P.removals(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_shared_line_amid_different_text(spark, monkeypatch):
    """Thousands of surroundings of one line: by 16 bits dozens of them would be taken for equal."""
    monkeypatch.setattr(P, "SHARD", 40_000)
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    line = "".join(rng.choices(letters, k=70))
    rows = [(k, "".join(rng.choices(letters, k=60)) + line + "".join(rng.choices(letters, k=60))) for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((repr(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in P.removals(docs).collect())
    assert got == _brute(rows)


def test_rows_without_key_are_told_apart(spark):
    """Thousands of texts under no key: by 16 bits some would take each other's spans."""
    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    line = "".join(rng.choices(letters, k=70))
    rows = [(1, line)] + [(None, "".join(rng.choices(letters, k=rng.randint(50, 200))) + (line if k % 2 else "")) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((repr(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in P.removals(docs).collect())
    assert got == _brute(rows)


@pytest.mark.parametrize("letters", [2, 4, 26])
def test_repeated_windows_of_a_shard_against_brute_force(letters):
    rng = np.random.default_rng(letters)
    texts = [rng.integers(97, 97 + letters, rng.integers(0, 400), dtype=np.uint8).tobytes() for _ in range(30)]
    texts += [a[: len(a) // 2] + b[len(b) // 3 :] for a, b in zip(texts, texts[1:])] + [b"ab" * 90, b"a" * 120, b"a" * 49]
    buffer, starts, ends = S.join_texts(texts)
    first: dict[bytes, int] = {}
    want = []
    for k, (start, text) in enumerate(zip(starts, texts)):
        for at in range(len(text) - S.SPAN + 1):
            if first.setdefault(text[at : at + S.SPAN], k) < k:
                want.append(start + at)
    got = S.repeated_windows(buffer, starts, S.window_starts(starts, ends, len(buffer)), np.arange(len(texts)))
    assert sorted(got) == want
