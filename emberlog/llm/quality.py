"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network with calibrated probabilities.

Words are counted as types: a short word of small letters is its own type, any other word is its shape (runs of small letters,
capitals and digits, other characters as they are), and a word that repeats the one before it is a type of its own; types are hashed
to ``TYPES`` buckets. Random indexing gives each type a sparse vector of +1 and -1 and each type's word vector is the sum of the
vectors of its neighbours within ``WINDOW`` words. A document is the mean of its words' vectors and of their squares, with a few
lengths. A network of one hidden layer learns labels from these; a temperature fitted on rows held back from training calibrates it.

Vectors and network are learned from about ``SAMPLE`` labelled documents, a documented bound; every text is scored whole.

Defined results: null text counts as empty and is scored like any other; without labelled rows every score is 0.5; repeated rows are
scored alike; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import fold, labelled_sample, text_of

TYPES, SIZE, SPARSE, WINDOW, HIDDEN, EPOCHS = 2048, 48, 6, 2, 24, 60
#: Labelled documents learned from, by label.
SAMPLE = {0: 4000, 1: 8000}
THRESHOLD, TASKS, KEPT = 0.3, 8, 150_000

_RUNS = ((re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), "a"), (re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"\d+"), "0"), (re.compile(r"(\W)\1+"), r"\1\1"))


def word_type(word: str) -> int:
    """The bucket of a word's type."""
    shape = word[:64]
    if not (len(word) <= 3 and word.isalpha() and word.islower()):
        for runs, mark in _RUNS:
            shape = runs.sub(mark, shape)
        shape = f"{shape[:8]} {min(len(word), 40) // 8}"
    return 1 + zlib.crc32(shape.encode("utf-8", "surrogatepass")) % (TYPES - 1)


def type_reader() -> Callable[[str], np.ndarray]:
    """A function from a text to its words' types, with a bounded cache; type 0 is a word that repeats the one before."""
    young: dict[str, int] = {}
    old: dict[str, int] = {}

    def read(text: str) -> np.ndarray:
        nonlocal young, old
        words = text.split()
        for word in set(words):
            if word not in young:
                young[word] = old.get(word) or word_type(word)
        types = np.fromiter(map(young.__getitem__, words), np.int64, len(words))
        if len(words) > 1:
            types[1:][np.fromiter(map(operator.eq, words[1:], words), bool, len(words) - 1)] = 0
        if len(young) > KEPT:
            young, old = {}, young
        return types

    return read


def index_vectors(seed: int = 11) -> np.ndarray:
    """A sparse ternary vector for each type."""
    rng = np.random.default_rng(seed)
    out = np.zeros((TYPES, SIZE))
    for row in out:
        row[rng.choice(SIZE, SPARSE, replace=False)] = rng.choice([-1.0, 1.0], SPARSE)
    return out


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    read, pairs = type_reader(), np.zeros(TYPES * TYPES, np.int64)
    for batch in batches:
        waiting, n = [], 0
        for text in batch.column(0):
            types = read(text.as_py())
            waiting += [types[:-k] * TYPES + types[k:] for k in range(1, WINDOW + 1) if len(types) > k]
            n += WINDOW * len(types)
            if n > 1_000_000:
                pairs += np.bincount(np.concatenate(waiting), minlength=TYPES * TYPES)
                waiting, n = [], 0
        if waiting:
            pairs += np.bincount(np.concatenate(waiting), minlength=TYPES * TYPES)
    pairs = pairs.reshape(TYPES, TYPES)
    yield pa.RecordBatch.from_arrays([pa.array([((pairs + pairs.T) @ index_vectors()).tobytes()], pa.binary())], ["sums"])


def pooled(types: np.ndarray, text: str, vectors: np.ndarray) -> np.ndarray:
    """A document's features."""
    n, lines = len(types), text.count("\n") + 1
    share = np.bincount(types, minlength=TYPES) / max(1, n)
    return np.concatenate([share @ vectors, share @ vectors**2, [np.log1p(n), np.log1p(len(text)) - np.log1p(n), np.log1p(n / lines), (share**2).sum(), share[0]]])


def _features(vectors: np.ndarray):
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = type_reader()
        for batch in batches:
            texts = [t.as_py() for t in batch.column(0)]
            rows = [pooled(read(t), t, vectors).astype(np.float32).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1)], ["x", "label"])

    return features


def train_network(x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 3) -> dict[str, np.ndarray]:
    """Two layers by Adam on four fifths of the rows; the temperature by its likelihood on the rest."""
    rng = np.random.default_rng(seed)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = np.clip((x - mean) / spread, -6, 6)
    back = rng.random(len(x)) < 0.2
    net = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in net], [np.zeros_like(p) for p in net], 0
    rows = np.flatnonzero(~back)
    for _ in range(EPOCHS):
        rng.shuffle(rows)
        for at in range(0, len(rows), 256):
            k = rows[at : at + 256]
            h = np.tanh(x[k] @ net[0] + net[1])
            off = (1 / (1 + np.exp(-(h @ net[2] + net[3]))) - y[k]) * weight[k] / len(k)
            inner = np.outer(off, net[2]) * (1 - h**2)
            slopes = [x[k].T @ inner + 1e-4 * net[0], inner.sum(axis=0), h.T @ off + 1e-4 * net[2], off.sum(keepdims=True)]
            step += 1
            for p, m, v, g in zip(net, first, second, slopes, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    logit = np.tanh(x @ net[0] + net[1]) @ net[2] + net[3]
    best, temperature = np.inf, 1.0
    for t in np.geomspace(0.25, 8, 60) if back.any() else ():
        loss = (weight[back] * np.logaddexp(0, np.where(y[back] == 1, -logit[back], logit[back]) / t)).sum()
        if loss < best:
            best, temperature = loss, t
    return {"mean": mean, "spread": spread, "w1": net[0], "b1": net[1], "w2": net[2] / temperature, "b2": net[3] / temperature}


def probability(x: np.ndarray, net: dict[str, np.ndarray]) -> np.ndarray:
    h = np.tanh(np.clip((x - net["mean"]) / net["spread"], -6, 6) @ net["w1"] + net["b1"])
    return 1 / (1 + np.exp(-(h @ net["w2"] + net["b2"])))


def learn(docs: DataFrame, labels: DataFrame, training: Callable[[Column], Column], label: str = "quality", key: str = "doc_id", text: str = "text", most: dict[int, int] = SAMPLE):
    """Word vectors and network, or None where no labelled rows are."""
    sample, counts = labelled_sample(docs, labels, label, training, most, key, text)
    sample = sample.repartition(TASKS)
    parts = sample.select("text").mapInArrow(_neighbours, "sums binary").collect() if counts else []
    vectors = sum((np.frombuffer(r.sums).reshape(TYPES, SIZE) for r in parts), np.zeros((TYPES, SIZE)))
    vectors = vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-9)
    rows = sample.mapInArrow(_features(vectors), "x binary, label int").collect() if counts else []
    if not rows:
        return None
    rows.sort(key=lambda r: (r.x, r.label))
    x, y = np.stack([np.frombuffer(r.x, np.float32) for r in rows]).astype(float), np.array([float(r.label > 0) for r in rows])
    drawn = {v: max(1, int((y == v).sum())) for v in (0, 1)}
    weight = np.where(y == 1, counts.get(1, 0) / drawn[1], counts.get(0, 0) / drawn[0])
    return vectors, train_network(x, y, weight / weight.mean())


def _scorer(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = type_reader()
        for batch in batches:
            rows = []
            for value in batch.column(1) if model else ():
                text = value.as_py()
                rows.append(pooled(read(text), text, model[0]))
            found = probability(np.stack(rows), model[1]) if rows else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["key", "score"])

    return score


def score_quality(docs: DataFrame, labels: DataFrame, training: Callable[[Column], Column], key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: ``<key>, score, predicted``."""
    model = learn(docs, labels, training, key=key, text=text)
    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(docs[key].alias("key"), text_of(docs[text]).alias("text")).mapInArrow(_scorer(model), f"key {kind}, score double")
    return out.select(F.col("key").alias(key), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def held_out(key: Column) -> Column:
    return F.coalesce(fold(key, 5) == 0, F.lit(False))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The registered query: learn from all folds but one, score every document."""
    return score_quality(docs, labels, lambda key: ~held_out(key)).withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "score", "predicted")
