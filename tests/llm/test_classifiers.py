import random

import numpy as np
from pyspark.sql import functions as F

from emberlog.llm import language_mixture as L
from emberlog.llm import quality as Q
from emberlog.llm import toxicity as T
from emberlog.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def _odd(spark):
    rows = [(1, None), (2, ""), (3, "12 34 !!"), (4, "the " * 30_000), (5, "é"), (5, "é"), (None, "the and of")]
    return spark.createDataFrame([(*r, "en", "s", 0.0) for r in rows], "doc_id long, text string, lang string, source string, score double")


def test_language_held_out(spark):
    rows = QUERIES["op2_language_id"](spark, SF).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_language_mixture_shares(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    by = {lang: " ".join(r.text for r in docs.where((F.col("lang") == lang) & (F.col("n_chars") > 1500)).limit(3).collect()) for lang in ("en", "de")}
    half = spark.createDataFrame([(1, by["en"][:3000] + by["de"][:1000], "fr"), (2, by["de"][:2000], None)], "doc_id long, text string, lang string")
    languages, likelihood = L.learn(docs, F.lit(True))
    share = L.infer(likelihood, L.trigram_counts(half.first().text))
    assert abs(share[languages.index("en")] - 0.75) < 0.1 and abs(share[languages.index("de")] - 0.25) < 0.1
    assert L.infer(likelihood, L.trigram_counts(by["de"][:2000]))[languages.index("de")] > 0.95


def test_expectation_maximisation_raises_likelihood():
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.ones(50), 3).T
    counts = rng.multinomial(2000, p @ [0.6, 0.3, 0.1])
    share, reached = L.proportions(p, counts, 200)
    assert np.abs(share - [0.6, 0.3, 0.1]).max() < 0.1
    assert reached >= L.proportions(p, counts, 3)[1] - 1e-9


def test_language_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(_odd(spark).drop("score").withColumn("n_chars", F.lit(1).cast("long")).withColumn("doc_id", F.col("doc_id") + 10_000))
    rows = {r.doc_id: r for r in L.identify(docs).collect() if r.doc_id is None or r.doc_id > 10_000}
    assert [rows[10_000 + k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and rows[None].lang_pred == "en"
    kept = L.with_language(docs)
    assert kept.columns == docs.columns and {10_001, 10_002, 10_003}.isdisjoint(r.doc_id for r in kept.select("doc_id").collect())
    unknown = L.identify(docs.withColumn("lang", F.lit(None).cast("string")).limit(20))
    assert {(r.lang_pred, r.score) for r in unknown.collect()} == {("und", 0.0)}
    assert L.identify(docs.limit(0)).collect() == []


def _auc(score, label):
    rank = np.argsort(np.argsort(score)) + 1
    ones = label.sum()
    return (rank[label == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(label) - ones))


def test_quality_and_toxicity_held_out(spark):
    labels = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    for name, column, least in (("op3_quality", "quality", 0.97), ("op9_toxicity", "toxic", 0.93)):
        rows = QUERIES[name](spark, "/root/testdata/sf0.1").collect()
        held = [r for r in rows if r.held_out and r.doc_id in labels]
        label = np.array([labels[r.doc_id][column] for r in held])
        assert _auc(np.array([r.score for r in held]), label) > least
        assert np.mean([r.predicted for r in held] == label) > 0.97
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= (0.3 if column == "quality" else 0.7)) for r in rows)


def test_edges_of_scores(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    more = labels.unionByName(spark.createDataFrame([(1, None, None), (2, 1, 0), (2, 0, 1)], labels.schema))
    docs = spark.read.parquet(f"{SF}/documents.parquet").drop("n_chars").withColumn("score", F.lit(0.0))
    both = docs.unionByName(_odd(spark).withColumn("doc_id", F.col("doc_id") + 10_000))
    for judge in (Q.judge, T.judge):
        rows = judge(both, more).collect()
        assert len(rows) == both.count() and all(0 <= r.score <= 1 for r in rows)
        assert judge(docs.limit(0), labels).collect() == []
        assert len(judge(docs.limit(30), labels.limit(0)).collect()) == 30


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 6))
    p = 1 / (1 + np.exp(-(2 * x[:, 0] * x[:, 1] + x[:, 2])))
    y = (rng.random(3000) < p).astype(float)
    net = Q.train_network(x, y, np.ones(3000))
    got = Q.probability(x, net)
    assert _auc(got, y) > 0.75
    for a, b in ((0, 0.3), (0.3, 0.6), (0.6, 1.01)):
        some = (got >= a) & (got < b)
        assert abs(got[some].mean() - y[some].mean()) < 0.08


def test_grammar():
    lexicon = T.Lexicon({"idio": 5.0, "scum$": 4.0})

    def matches(text):
        return list(T.clause_matches(text.lower(), lexicon))

    assert matches("You idiot.") == [(4, 5.0)]
    assert matches("an idiot") == [(0, 5.0)]
    assert matches("scumbag and scum") == [(0, 4.0)]
    assert matches("he is not an idiot") == [(5, 5.0)]
    assert matches("not a word about this at all, idiot") == [(0, 5.0)]
    assert matches("she said they are scum") == [(6, 4.0)]
    assert matches("I will hurt them") == [(12, 1.0)]
    assert matches("all is well. you") == [] and matches("") == []


def test_composition_is_side_by_side():
    rng = random.Random(1)
    a = T.Transducer(2, {(0, T.TARGET): (1, 4), (0, -1): (0, 0), (1, -1): (1, 4)})
    b = T.Transducer(2, {(0, T.REPORT): (1, 0), (0, -1): (0, 0), (1, -1): (1, 16)})
    both = a.compose(b)
    for _ in range(50):
        s = p = q = 0
        for c in (rng.randrange(6) for _ in range(12)):
            s, out = both.step[s][c]
            p, x = a.step[p][c]
            q, y = b.step[q][c]
            assert out == x | y


def test_signs_that_are_no_letters_have_no_language(spark):
    from emberlog.llm import language_mixture

    docs = spark.createDataFrame([(k, "ein kurzer Text und noch einer", "de") for k in range(8)] + [(90 + k, t, None) for k, t in enumerate(["½ ² Ⅳ", "123 !!", "_", "ª"])], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_mixture.identify(docs).collect()}
    assert [got[90 + k] for k in range(4)] == ["und", "und", "und", "de"]
