import random
from collections import Counter

from emberlog.llm import decontaminate as D

ITEMS = [(1, "What is the capital of the old northern kingdom by the sea? It was the town of Harrowgate."), (2, "Photosynthesis turns light into sugar. Leaves do most of that work in the morning hours."),
         (3, "tiny item here"), (4, None), (5, "..."), (6, "Photosynthesis turns light into sugar. Leaves do most of that work in the morning hours.")]


def _index(items):
    texts = [t for _, t in items if t]
    words = [D.words_of(t) for t in texts]
    return D.ItemIndex(items, (len(texts), sum(map(len, words)) / len(words), Counter(w for ws in words for w in set(ws))))


def test_bounds_miss_no_item():
    """What block maxima let pass is what scoring every item for every passage finds."""
    rng = random.Random(2)
    words = [f"w{k}" for k in range(300)] + ["the", "of", "and"] * 40
    items = [(k, " ".join(rng.choices(words, k=rng.randint(3, 40)))) for k in range(150)]
    for long in (64, 3):
        D.LONG, kept = long, D.LONG
        index = _index(items)
        for _ in range(25):
            text = " ".join([*rng.choices(words, k=rng.randint(0, 150)), rng.choice(items)[1], *rng.choices(words, k=rng.randint(0, 90)), rng.choice(items)[1]])
            ids = [index.vocabulary.get(w, -1) for w in D.words_of(text)]
            want, s = set(), index.segment
            for passage in range(max(1, -(-len(ids) // s) - 1)):
                have = set(ids[passage * s : (passage + 2) * s])
                want |= {(passage, k) for k, weights in enumerate(index.impacts) if sum(w for t, w in weights.items() if t in have) >= D.RETRIEVE}
            import numpy as np

            assert {(p, k) for p, k, _ in index.retrieve(np.array(ids))} == want
        D.LONG = kept


def _plain(items, text):
    words = D.words_of(text or "")
    seen = D.shingles_of(words)

    def held(part):
        own = D.words_of(part)
        return len(s & seen) / len(s) >= 0.8 if (s := D.shingles_of(own)) and len(own) >= 5 else bool(own) and f" {' '.join(own)} " in f" {' '.join(words)} "

    return {key for key, item in items if item and (held(item) or any(held(part) for part in D.question_and_answer(item) if len(D.words_of(part)) >= D.PART))}


def test_question_answer_or_item_without_rare_words():
    rng = random.Random(6)
    common, rare = [f"c{k}" for k in range(40)], iter(f"r{k}" for k in range(10_000))
    items = []
    for key in range(120):
        question = [rng.choice(common) if rng.random() < 0.6 else next(rare) for _ in range(rng.randint(6, 30))]
        answer = [rng.choice(common) if rng.random() < 0.6 else next(rare) for _ in range(rng.randint(1, 14))]
        items.append((key, f"{' '.join(question)}? {' '.join(answer)}."))
    index = _index(items)
    hits = alone = 0
    for key, text in items:
        words = text.replace("?", " ?").split()
        question, answer = (part.split() for part in D.question_and_answer(text))
        for part in (words, question, answer, words[: -len(words) // 6], words[len(words) // 6 :], words[:9] + words[11:]):
            weight = index.impacts[index.entry_item.index(key)]
            light = sorted(set(part), key=lambda w: weight.get(index.vocabulary.get(w, -1), 0.0))
            for body in (part, [w for w in part if w not in light[-3:]]):
                passage = " ".join([*rng.choices(common, k=rng.randint(0, 60)), *body, *rng.choices(common, k=50)])
                want = _plain(items, passage)
                assert set(index.matches(passage)) >= {index.keys.index(k) for k in want} and {index.keys[k] for k in index.matches(passage)} == want
                hits += key in want
                alone += key in want and body in (question, answer)
    assert hits > 400 and alone > 120


def test_documents(spark):
    rng = random.Random(1)
    filler = ["plain", "words", "the", "of", "sea", "town", "light", "morning", "work", "in"]
    docs = [(0, None), (1, ""), (2, "tiny item here"), (3, "x " * 50_000 + ITEMS[0][1] + " y" * 50_000)]
    for k in range(10, 80):
        parts = [" ".join(rng.choices(filler, k=rng.randint(0, 200)))]
        if rng.random() < 0.6:
            words = rng.choice([ITEMS[0][1], ITEMS[1][1], ITEMS[2][1]]).upper().split()
            cut = rng.choice([0, 0, 0, 1, 5])
            parts.append(" ".join(words[: len(words) - cut]))
        parts.append(" ".join(rng.choices(filler, k=rng.randint(0, 150))))
        docs.append((k, " ".join(parts)))
    docs.append((10, docs[4][1]))
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, score string")
    items = spark.createDataFrame([(*i, 1.0) for i in ITEMS], "item_id long, text string, overlap double")
    want = sorted((key, item) for key, text in docs for item in _plain(ITEMS, text))
    assert len(want) > 20
    for chars in (D.INDEX_CHARS, 60):
        assert sorted((r.doc_id, r.item_id) for r in D.contaminated(df, items, chars=chars).collect()) == want
        clean = D.without_benchmark(df, items, chars=chars)
        assert clean.columns == df.columns and sorted(r.doc_id for r in clean.collect()) == sorted(k for k, t in docs if not _plain(ITEMS, t))


def test_question_and_answer():
    assert D.question_and_answer("Who? Me.") == ("Who", " Me.")
    assert D.question_and_answer("One. Two. Three.") == ("One. Two.", "Three.")
    assert D.question_and_answer("only") == ("only", "")


def test_registered_query_and_empty(spark):
    from emberlog.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted((r.doc_id, item) for r in docs.collect() for item in _plain(items, r.text))
    assert sorted((r.doc_id, r.item_id) for r in QUERIES["op7_decontamination"](spark, sf).collect()) == want and want
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(docs, none).collect() == [] and D.without_benchmark(docs.limit(5), none).count() == 5
    assert D.contaminated(spark.createDataFrame([], docs.schema), spark.read.parquet(f"{sf}/benchmark.parquet")).collect() == []
