"""Toxicity by a weighted finite-state pattern grammar.

Five transducers read the words of a clause: insult and threat words mark their classes and weights, target words (you, they, names
of persons) bind an insult, negation weakens one that follows it within ``REACH`` words, and reported speech lasts to the clause's
end. They are composed once into one table over (state, word class); running a clause through the table gives its matches, each an
insult or threat together with its context, never a word alone. Clause matches are summed by context, and a regression learned from
labels turns the sums into a probability.

The insult lexicon is an automaton of whole words and word beginnings that labelled toxic documents use and others do not. It and
the regression are learned from about ``SAMPLE`` labelled documents, a documented bound; every text is scored whole.

Defined results: null text counts as empty; a document without a match gets the regression's score for none; without labelled rows
the lexicon is empty and scores come from fixed weights; repeated rows are scored alike; an empty table gives no rows; other columns
play no part.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import fold, labelled_sample, text_of

#: Word classes, the input alphabet of the grammar.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
WORDS = {
    THREAT: "kill hurt destroy beat burn shoot stab attack tuer frapper brûler töten schlagen verbrennen matar golpear quemar".split(),
    TARGET: "you your you're yourself he she they them him her tu toi vous ils elles du dich ihr euch sie tú usted ustedes ellos ellas".split(),
    NEGATION: "not no never n't don't isn't aren't cannot nobody without pas jamais sans nicht kein keine nie ohne nunca sin".split(),
    REPORT: "said says wrote claims claimed quoted quote reported called dit disait écrit sagte sagt schrieb berichtete dijo dice escribió".split(),
}
REACH = 3
#: Labelled documents learned from, by label; word beginnings considered; least toxic documents with an entry; entries kept.
SAMPLE = {1: 2000, 0: 6000}
BEGINNINGS, LEAST, ENTRIES = (4, 5, 6, 7), 4, 4000
THRESHOLD, KEPT = 0.7, 150_000
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
CLAUSE = re.compile(r"[.!?;:\n]+\s*|\|")
#: Contexts of a match: bound to a target or not, negated or not, reported or not, for insults and for threats.
CONTEXTS = 16


class Transducer:
    """A deterministic transducer over word classes: ``step[state][class] = (next state, output)``, state 0 first."""

    def __init__(self, states: int, arcs: dict[tuple[int, int], tuple[int, int]]):
        self.step = [[arcs.get((state, c), arcs.get((state, -1), (state, 0))) for c in range(6)] for state in range(states)]

    def compose(self, other: Transducer) -> Transducer:
        """Both side by side on the same words; outputs are disjoint bits and are joined."""
        pairs = list(itertools.product(range(len(self.step)), range(len(other.step))))
        place = {pair: k for k, pair in enumerate(pairs)}
        out = Transducer(0, {})
        out.step = [[(place[a[0], b[0]], a[1] | b[1]) for a, b in zip(self.step[p], other.step[q], strict=True)] for p, q in pairs]
        return out


def grammar() -> Transducer:
    """Output bits: 1 insult, 2 threat, 4 after a target, 8 negated, 16 reported."""
    insult = Transducer(1, {(0, INSULT): (0, 1)})
    threat = Transducer(1, {(0, THREAT): (0, 2)})
    target = Transducer(2, {(0, TARGET): (1, 4), (0, -1): (0, 0), (1, -1): (1, 4)})
    negation = {(0, NEGATION): (REACH, 0), (0, -1): (0, 0)}
    for left in range(1, REACH + 1):
        negation |= {(left, NEGATION): (REACH, 8), (left, -1): (left - 1, 8)}
    report = Transducer(2, {(0, REPORT): (1, 0), (0, -1): (0, 0), (1, -1): (1, 16)})
    return insult.compose(threat).compose(target).compose(Transducer(REACH + 1, negation)).compose(report)


GRAMMAR = grammar()


class Lexicon:
    """Word classes and insult weights, with a bounded cache. Entries end in ``$`` for whole words, else they are word beginnings."""

    def __init__(self, entries: dict[str, float]):
        self.fixed = {word: kind for kind, words in WORDS.items() for word in words}
        self.entries, self.sizes = entries, sorted({len(e) for e in entries if not e.endswith("$")})
        self.young: dict[str, tuple[int, float]] = {}
        self.old: dict[str, tuple[int, float]] = {}

    def classify(self, word: str) -> tuple[int, float]:
        """A lower-case word's class and weight: a fixed word's class, else the heaviest entry on its path through the automaton."""
        weight = self.entries.get(word + "$", 0.0)
        for n in self.sizes:
            weight = max(weight, self.entries.get(word[:n], 0.0) if len(word) >= n else 0.0)
        if weight > 0:
            return INSULT, weight
        kind = self.fixed.get(word, OTHER)
        return kind, float(kind == THREAT)

    def rough(self, token: str) -> bool:
        """Whether a run without white space may hold an insult or a threat."""
        return any(self.classify(w)[0] in (INSULT, THREAT) for w in WORD.findall(token))

    def may_match(self, tokens: set[str]) -> bool:
        found = False
        for token in tokens:
            hit = self.young.get(token)
            if hit is None:
                hit = self.young[token] = self.old.get(token) or (int(self.rough(token)), 0.0)
            found = found or hit[0] == 1
        if len(self.young) > KEPT:
            self.young, self.old = {}, self.young
        return found


def clause_matches(text: str, lexicon: Lexicon) -> Iterator[tuple[int, float]]:
    """Context and weight of every match, clause by clause. A target anywhere in the clause binds its matches."""
    for clause in CLAUSE.split(text):
        found = [lexicon.classify(word) for word in WORD.findall(clause)]
        if not any(kind in (INSULT, THREAT) for kind, _ in found):
            continue
        bound, state = any(kind == TARGET for kind, _ in found), 0
        for kind, weight in found:
            state, out = GRAMMAR.step[state][kind]
            if out & 3:
                yield (out >> 3) | (4 if bound or out & 4 else 0) | (8 if out & 2 else 0), weight


def matched(text: str, lexicon: Lexicon) -> np.ndarray:
    """A document's features: sums of match weights by context, the number of matches and its share of the words."""
    lower = text.lower()
    out = np.zeros(CONTEXTS + 3)
    if lexicon.may_match(set(lower.split())):
        sums, n = [0.0] * CONTEXTS, 0
        for context, weight in clause_matches(lower, lexicon):
            sums[context] += weight
            n += 1
        words = len(lower.split())
        out[:CONTEXTS] = np.log1p(sums)
        out[CONTEXTS:] = [np.log1p(sum(sums)), np.log1p(n), sum(sums) / np.sqrt(words + 10)]
    return out


def candidate_entries(sample: DataFrame) -> DataFrame:
    """``entry, toxic, other``: how many sampled documents of either label have a word that is, or begins with, the entry."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+(?:'[\p{L}]+)*"), F.lit(0)))
    starts = F.flatten(F.transform(words, lambda w: F.concat(F.array(F.concat(w, F.lit("$"))), F.filter(F.array(*[F.substring(w, 1, n) for n in BEGINNINGS]), lambda s: F.length(s) < F.length(w)))))
    entries = sample.select("label", F.explode(F.array_distinct(starts)).alias("entry")).where(F.length("entry") >= min(BEGINNINGS))
    return entries.groupBy("entry").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("other")).where(F.col("toxic") >= LEAST)


def choose_entries(rows: Sequence[tuple[str, int, int]], toxic: int, other: int) -> dict[str, float]:
    """Entries whose log odds stay above 2 at their lower bound; a longer one is left out where a beginning of it weighs as much."""
    chosen: dict[str, float] = {}
    for entry, t, n in sorted(rows, key=lambda r: (len(r[0]), r[0])):
        odds = np.log((t + 0.5) / (toxic + 1)) - np.log((n + 0.5) / (other + 1))
        weight = odds - 1.3 * np.sqrt(1 / (t + 0.5) + 1 / (n + 0.5))
        if weight > 2.0 and not any(chosen.get(entry[:k], 0.0) >= weight - 0.5 for k in BEGINNINGS):
            chosen[entry] = float(weight)
    return dict(sorted(chosen.items(), key=lambda e: (-e[1], e[0]))[:ENTRIES])


def _features(entries: dict[str, float]):
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(entries)
        for batch in batches:
            rows = [matched(text.as_py(), lexicon).tobytes() for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1)], ["x", "label"])

    return features


def fit_regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a ridge; the last entry is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-2 * max(1.0, weight.sum() / len(y)))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        w -= np.clip(np.linalg.solve(bend, slope), -2, 2)
    return w


#: Where nothing was learned: any match counts, less so when negated or reported.
PLAIN = np.array([1.0, 0.4, 0.3, 0.2, 1.5, 0.6, 0.4, 0.3] * 2 + [0.5, 0.5, 0.0, -4.0])


def learn(docs: DataFrame, labels: DataFrame, training: Callable[[Column], Column], label: str = "toxic", key: str = "doc_id", text: str = "text", most: dict[int, int] = SAMPLE):
    """The lexicon's entries and the regression's weights. What reaches the driver is bounded by ``SAMPLE`` and ``ENTRIES``."""
    sample, counts = labelled_sample(docs, labels, label, training, most, key, text)
    if not counts:
        return {}, PLAIN
    sample = sample.withColumn("label", (F.col("label") > 0).cast("int"))
    sizes = {v: min(most[v], counts.get(v, 0)) for v in (0, 1)}
    lift = (F.col("toxic") + 0.5) / (sizes[1] + 1) / ((F.col("other") + 0.5) / (sizes[0] + 1))
    strong = candidate_entries(sample).where(lift > float(np.exp(2.0))).orderBy(F.desc("toxic"), "other", "entry").limit(10 * ENTRIES)
    entries = choose_entries([(r.entry, r.toxic, r.other) for r in strong.collect()], sizes[1], sizes[0])
    rows = sample.mapInArrow(_features(entries), "x binary, label int").collect()
    if len({r.label for r in rows}) < 2:
        return entries, PLAIN
    rows.sort(key=lambda r: (r.x, r.label))
    x, y = np.stack([np.frombuffer(r.x) for r in rows]), np.array([float(r.label) for r in rows])
    weight = np.where(y == 1, counts.get(1, 0) / (y == 1).sum(), counts.get(0, 0) / (y == 0).sum())
    return entries, fit_regression(x, y, weight / weight.mean())


def _scorer(entries: dict[str, float], weights: np.ndarray):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(entries)
        for batch in batches:
            x = np.stack([matched(text.as_py(), lexicon) for text in batch.column(1)]) if batch.num_rows else np.zeros((0, CONTEXTS + 3))
            found = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["key", "score"])

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, training: Callable[[Column], Column], key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: ``<key>, score, predicted``."""
    model = learn(docs, labels, training, key=key, text=text)
    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(docs[key].alias("key"), text_of(docs[text]).alias("text")).mapInArrow(_scorer(*model), f"key {kind}, score double")
    return out.select(F.col("key").alias(key), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def held_out(key: Column) -> Column:
    return F.coalesce(fold(key, 3) == 1, F.lit(False))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The registered query: learn from all folds but one, score every document."""
    return score_toxicity(docs, labels, lambda key: ~held_out(key)).withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "score", "predicted")
