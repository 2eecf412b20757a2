"""Language ID by mixture inference.

Byte trigrams of the lower-cased text are counted in ``BUCKETS`` buckets; each learned language has a smoothed distribution over
them. A document is a mixture: expectation-maximisation estimates its language proportions from the trigram likelihoods, and the set
of languages is the one with the best penalised likelihood among the most proportionate one, two, three, ... languages.

The distributions are learned from about ``SAMPLE`` documents a language, a documented bound; everything else reads all texts whole.

Defined results: null text and text without a letter are ``und`` with score 0, as is every text where no language was learned; equal
proportions give the language first by name; repeated rows are predicted alike; an empty table gives no rows; other columns play no
part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import bounded_sample, fold, text_of

BUCKETS, SAMPLE, SMOOTHING, ROUNDS = 1 << 14, 1500, 0.5, 25
#: Neighbouring trigrams share letters: so many of them count as one independent observation. Price of one more language.
OVERLAP, PRICE = 3.0, 2.0
#: Tasks that add up the sample.
TASKS = 8

#: Bytes as they count: A-Z lower-cased, other ASCII but letters as a space.
_SEEN = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint32)


def trigram_counts(text: str) -> np.ndarray:
    """How often each bucket's trigrams occur; white space alone is left out."""
    seen = _SEEN[np.frombuffer(f" {text} ".encode("utf-8", "surrogatepass"), np.uint8)]
    grams = (seen[:-2] << 16) | (seen[1:-1] << 8) | seen[2:]
    grams = grams[(grams & 0xFFFF) != 0x2020]
    return np.bincount((grams * np.uint32(2654435761)) >> np.uint32(18), minlength=BUCKETS)


def proportions(likelihood: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Mixture weights by expectation-maximisation, and the log likelihood they reach. ``likelihood``: a row a trigram, a column a language."""
    share = np.full(likelihood.shape[1], 1 / likelihood.shape[1])
    total = counts.sum()
    for _ in range(rounds if len(share) > 1 else 0):
        new = share * ((counts / (likelihood @ share)) @ likelihood) / total
        done = np.abs(new - share).max() < 1e-4
        share = new
        if done:
            break
    return share, float(counts @ np.log(likelihood @ share))


def infer(likelihood: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Proportions over all languages, zero outside the set that the penalised likelihood selects."""
    at = np.flatnonzero(counts)
    seen, part = counts[at].astype(float), likelihood[at]
    order = np.argsort(-proportions(part, seen)[0], kind="stable")
    best, chosen = -np.inf, None
    for size in range(1, len(order) + 1):
        share, reached = proportions(part[:, order[:size]], seen)
        reached = reached / OVERLAP - PRICE * (size - 1) * np.log(seen.sum() + 1)
        if reached <= best:
            break
        best, chosen = reached, share
    out = np.zeros(likelihood.shape[1])
    out[order[: len(chosen)]] = chosen
    return out


def _add_up(languages: list[str]):
    place = {name: k for k, name in enumerate(languages)}

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(languages), BUCKETS))
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                sums[place[lang]] += trigram_counts(text.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["sums"])

    return add_up


def learn(docs: DataFrame, training: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", most: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """The languages, by name, and each bucket's likelihood under them, a column each."""
    rows = docs.where(training).select(text_of(docs[text]).alias("text"), docs[lang].alias("lang"), docs[key].alias("key"))
    sample, counts = bounded_sample(rows, "lang", most, "key")
    languages = sorted(counts)
    if not languages:
        return [], np.zeros((BUCKETS, 0))
    parts = sample.select("text", "lang").repartition(TASKS).mapInArrow(_add_up(languages), "sums binary").collect()
    sums = sum(np.frombuffer(r.sums).reshape(len(languages), BUCKETS) for r in parts) + SMOOTHING
    return languages, np.ascontiguousarray((sums / sums.sum(axis=1, keepdims=True)).T)


def _predictor(languages: list[str], likelihood: np.ndarray):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, mixes = [], [], []
            for value in batch.column(1):
                text = value.as_py()
                if not languages or text is None or not any(map(str.isalpha, text)):
                    names.append("und"), scores.append(0.0), mixes.append(None)
                    continue
                share = infer(likelihood, trigram_counts(text))
                top = int(share.argmax())
                names.append(languages[top]), scores.append(float(min(1.0, share[top])))
                mixes.append([(languages[k], float(share[k])) for k in np.flatnonzero(share)])
            kind = pa.map_(pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(mixes, kind)], ["key", "lang_pred", "score", "mixture"])

    return predict


def predict_languages(docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", most: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: ``<key>, lang_pred, score, mixture``; ``training`` says which rows' languages may be learned from."""
    model = learn(docs, training, text, lang, key, most)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return rows.mapInArrow(_predictor(*model), f"key {kind}, lang_pred string, score double, mixture map<string,double>").withColumnRenamed("key", key)


def held_out(key: Column) -> Column:
    return fold(key, 4) == 2


def identify(docs: DataFrame) -> DataFrame:
    """The registered query: learn from all folds but one, predict every document."""
    out = predict_languages(docs, ~F.coalesce(held_out(docs["doc_id"]), F.lit(False)))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "mixture")


def with_language(docs: DataFrame, least: float = 0.25, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are in some language: its share is ``least`` or more. The texts are read once, keys do not matter."""
    languages, likelihood = learn(docs, F.lit(True), text, lang, key)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = _predictor(languages, likelihood)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            found = next(predict(iter([pa.RecordBatch.from_arrays([texts, texts], ["key", "text"])])))
            keep = [name != "und" and score >= least for name, score in zip(found.column(1).to_pylist(), found.column(2).to_pylist(), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(judge, docs.schema)
