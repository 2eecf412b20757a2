"""Benchmark decontamination by BM25 retrieval with block maxima.

The test items are the indexed side; every passage of every training document is a query. An item is indexed as a whole, and its
question and its answer (what follows the last question mark, else the last sentence) as entries of their own if they have
``PART`` words or more, so that either alone is found too. A document's words are cut into segments, no shorter than any entry, and a
passage is two neighbouring segments, so a copied entry lies whole in a passage.

A match is an entry of which ``OVERLAP`` of the five-word shingles occur in the passage. Each missing word takes a shingle away, at
least, so such a passage holds all but a known number of the entry's words; an entry's BM25 weights are divided by what is left without so
many of the heaviest. A passage that is a match therefore scores 1 or more: retrieval loses none.

Entries are kept in blocks; each term has the largest weight in each block where it occurs. As in block-max WAND a passage's upper
bound in a block is the sum of its terms' block maxima, terms that occur nearly everywhere counting by their overall maximum alone,
and only entries of blocks whose bound reaches 1 are scored. All above are verified by the overlaps of item, question and answer.

The index is built from bounded groups of items, ``INDEX_CHARS`` characters each, so what a task holds does not grow with the
benchmark; statistics are those of all items.

Defined results: null or empty texts and items match nothing; items of fewer than five words count as one shingle; an item
without an answer, or with parts of fewer than ``PART`` words, is matched as a whole alone; repeated rows are
matched alike; equal items are all reported; empty tables give no rows; other columns play no part.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import text_of

K1, B, SHINGLE, OVERLAP, BLOCK, SEGMENT = 1.2, 0.75, 5, 0.8, 8, 64
#: Words of a question or an answer that is looked for alone; the score of retrieval.
PART, RETRIEVE = 8, 1 - 1e-9
#: A term in more blocks than this counts by its overall maximum at first.
LONG = 64
#: Characters of item text in one index.
INDEX_CHARS = 20_000_000
#: Cells of the bound table that are worked on at a time.
CELLS = 2_000_000
WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"(?<=[.!?])\s+(?=\S)")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def shingles_of(words: Sequence[str]) -> set[str]:
    """Five-word shingles; fewer words make one."""
    return {" ".join(words[k : k + SHINGLE]) for k in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def question_and_answer(text: str) -> tuple[str, str]:
    """What stands before the last question mark and after it; else all sentences but the last, and the last."""
    head, mark, tail = text.rpartition("?")
    if mark and tail.strip():
        return head, tail
    parts = SENTENCE.split(text.strip())
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, "")


def missing_words(words: Sequence[str]) -> int:
    """How many different words a passage may lack that has ``OVERLAP`` of the shingles.

    Words that lack where a shingle occurs several times may share one lost shingle; such an entry is not bounded, all may lack but one.
    """
    shingles = len(shingles_of(words))
    if len(words) < SHINGLE:
        return 0
    if shingles < len(words) - SHINGLE + 1:
        return len(set(words)) - 1
    return int((1 - OVERLAP) * shingles + 1e-9)


class ItemIndex:
    """Items, their entries and weights, and block maxima by term. ``stats``: number of items, mean words, items that have a term."""

    def __init__(self, items: Sequence[tuple[int, str]], stats: tuple[int, float, dict[str, int]]):
        total, mean, having = stats
        texts = sorted(((key, text, words_of(text)) for key, text in items if text), key=lambda x: (len(x[2]), x[0] or 0))
        texts = [x for x in texts if x[2]]
        self.keys = [key for key, _, _ in texts]
        self.shingles = [shingles_of(words) for _, _, words in texts]
        self.parts = [tuple(shingles_of(words_of(part)) for part in question_and_answer(text)) for _, text, _ in texts]
        self.segment = max([SEGMENT, *(math.ceil(1.25 * len(words)) for _, _, words in texts)])
        entries = [(k, 0, words) for k, (_, _, words) in enumerate(texts)]
        for k, (_, text, words) in enumerate(texts):
            parts = [words_of(part) for part in question_and_answer(text)]
            entries += [(k, place, part) for place, part in enumerate(parts, 1) if PART <= len(part) < len(words)]
        entries.sort(key=lambda e: len(e[2]))
        self.entry_item, self.entry_part = [k for k, _, _ in entries], [place for _, place, _ in entries]
        self.vocabulary: dict[str, int] = {}
        self.impacts: list[dict[int, float]] = []
        best: dict[tuple[int, int], float] = {}
        for e, (_, _, words) in enumerate(entries):
            weight = {}
            for word, tf in Counter(words).items():
                idf = math.log(1 + (total - having[word] + 0.5) / (having[word] + 0.5))
                weight[self.vocabulary.setdefault(word, len(self.vocabulary))] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean))
            heaviest = sorted(weight.values(), reverse=True)
            sure = sum(heaviest[missing_words(words) :])
            self.impacts.append({t: w / sure for t, w in weight.items()})
            for t, w in self.impacts[-1].items():
                best[t, e // BLOCK] = max(best.get((t, e // BLOCK), 0.0), w)
        self.own = [(np.array(list(weight), np.int64), np.array(list(weight.values()))) for weight in self.impacts]
        self.blocks = -(-len(entries) // BLOCK)
        self.block, self.most, self.block_start = self._lists(sorted((t, b, w) for (t, b), w in best.items()))
        self.highest = np.zeros(len(self.vocabulary))
        for terms, weights in self.own:
            np.maximum.at(self.highest, terms, weights)
        self.common = np.diff(self.block_start) > LONG

    def _lists(self, rows: list[tuple[int, int, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inverted lists: places, weights, and where each term's begin."""
        terms = np.array([t for t, _, _ in rows], np.int64)
        return np.array([x for _, x, _ in rows], np.int64), np.array([w for _, _, w in rows]), np.searchsorted(terms, np.arange(len(self.vocabulary) + 1))

    @staticmethod
    def _reading(start: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the lists of ``term`` lie, one after the other, and how long each is."""
        count = start[term + 1] - start[term]
        return np.repeat(start[term] - (np.cumsum(count) - count), count) + np.arange(count.sum()), count

    def bounds(self, segment: np.ndarray, term: np.ndarray, segments: int) -> np.ndarray:
        """Sums of block maxima, a row a segment, a column a block."""
        at, count = self._reading(self.block_start, term)
        return np.bincount(np.repeat(segment, count) * self.blocks + self.block[at], self.most[at], segments * self.blocks).reshape(segments, self.blocks)

    def retrieve(self, terms: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """Passage (its first segment), entry and score of all that reach ``RETRIEVE``; ``terms`` has -1 for words no item has."""
        here = np.zeros(len(self.vocabulary), bool)
        last = max(1, -(-len(terms) // self.segment) - 1)
        step = max(1, CELLS // max(1, self.blocks))
        for first in range(0, last, step):
            n = min(step, last - first)
            own = terms[first * self.segment : (first + n + 1) * self.segment]
            at = np.flatnonzero(own >= 0)
            if not len(at):
                continue
            segment, term = np.divmod(np.unique(at // self.segment * len(self.vocabulary) + own[at]), len(self.vocabulary))
            common = self.common[term]
            base = np.bincount(segment[common], self.highest[term[common]], n + 1)
            held = self.bounds(segment[~common], term[~common], n + 1)
            floor = base[:-1] + base[1:]
            reach = held[:-1] + held[1:] + floor[:, None] >= RETRIEVE
            for k in np.flatnonzero(floor >= RETRIEVE).tolist():  # common terms alone could do: their block maxima decide
                mine = (segment >= k) & (segment <= k + 1)
                reach[k] = self.bounds(np.zeros(mine.sum(), np.int64), term[mine], 1)[0] >= RETRIEVE
            for k in np.flatnonzero(reach.any(axis=1)).tolist():
                mine = term[(segment >= k) & (segment <= k + 1)]
                here[mine] = True
                for block in np.flatnonzero(reach[k]).tolist():
                    for entry in range(block * BLOCK, min((block + 1) * BLOCK, len(self.own))):
                        terms_of, weights = self.own[entry]
                        score = float(weights[here[terms_of]].sum())
                        if score >= RETRIEVE:
                            yield first + k, entry, score
                here[mine] = False

    def matches(self, text: str) -> dict[int, tuple[float, float, float, float]]:
        """Verified items of a text: score, and overlap of the item, its question and its answer, of the best passage."""
        words = words_of(text)
        terms = np.array(list(map(self.vocabulary.get, words, itertools.repeat(-1))), np.int64)
        found: dict[int, tuple[float, float, float, float]] = {}
        at, seen = -1, set()
        for passage, entry, score in self.retrieve(terms) if self.keys else ():
            item = self.entry_item[entry]
            if passage != at:
                at, seen = passage, shingles_of(words[passage * self.segment : (passage + 2) * self.segment])
            share = [len(s & seen) / len(s) if s else 0.0 for s in (self.shingles[item], *self.parts[item])]
            if len(self.shingles[item]) == 1 and len(next(iter(self.shingles[item])).split()) < SHINGLE:
                short = f" {next(iter(self.shingles[item]))} "
                share[0] = float(short in f" {' '.join(words[passage * self.segment : (passage + 2) * self.segment])} ")
            if share[self.entry_part[entry]] >= OVERLAP and (item not in found or share[0] > found[item][1]):
                found[item] = (score, *share)
        return found


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(word, len(words)) for text in batch.column(0).to_pylist() for words in [words_of(text or "")] for word in sorted(set(words))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["term", "words"])


def item_indexes(items: DataFrame, key: str = "item_id", text: str = "text", chars: int = INDEX_CHARS) -> Iterator[ItemIndex]:
    """Indexes of all items, each of a bounded group, with the statistics of the whole benchmark."""
    rows = items.select(items[key].cast("long").alias("key"), text_of(items[text]).alias("text")).where(F.length("text") > 0)
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()["chars"]
    groups = max(1, math.ceil(size / chars))
    if groups == 1:
        held = [(r.key, r.text) for r in rows.collect()]
        words = [words_of(t) for _, t in held]
        yield ItemIndex(held, (len(held), max(1.0, sum(map(len, words)) / max(1, len(held))), Counter(w for ws in words for w in set(ws))))
        return
    having = rows.select("text").mapInArrow(_terms, "term string, words long").groupBy("term").agg(F.count("*").alias("having"))
    n, length = rows.count(), rows.select("text").mapInArrow(_lengths, "words long").agg(F.avg("words")).first()[0]
    for group in range(groups):
        own = rows.where(F.pmod(F.xxhash64("key", "text"), F.lit(groups)) == group)
        terms = own.select("text").mapInArrow(_terms, "term string, words long").select("term").distinct().join(having, "term")
        yield ItemIndex([(r.key, r.text) for r in own.collect()], (n, max(1.0, length), {r.term: r.having for r in terms.collect()}))


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([len(words_of(t or "")) for t in batch.column(0).to_pylist()], pa.int64())], ["words"])


def _matcher(index: ItemIndex):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at, text in enumerate(batch.column(1)):
                rows += [(at, index.keys[item], *values) for item, values in sorted(index.matches(text.as_py()).items())]
            columns = [batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.int64())]
            columns += [pa.array([r[k] for r in rows], pa.float64()) for k in range(2, 6)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "item", "score", "overlap", "question_overlap", "answer_overlap"])

    return match


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", chars: int = INDEX_CHARS) -> DataFrame:
    """A row for each document and item whose passage it holds: ``<key>, <item>, score, overlap, question_overlap, answer_overlap``."""
    kind = docs.schema[key].dataType.simpleString()
    rows, out = docs.select(docs[key].alias("key"), text_of(docs[text]).alias("text")), None
    for index in item_indexes(items, item, item_text, chars):
        found = rows.mapInArrow(_matcher(index), f"key {kind}, item long, score double, overlap double, question_overlap double, answer_overlap double")
        out = found if out is None else out.unionByName(found)
    return out.withColumnsRenamed({"key": key, "item": item})


def without_benchmark(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", chars: int = INDEX_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no item's passage; texts are read once for each index."""

    def clean(index: ItemIndex):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text))
                yield batch.filter(pa.array([not index.matches(t.as_py() or "") for t in texts], pa.bool_()))

        return keep

    for index in item_indexes(items, item, item_text, chars):
        docs = docs.mapInArrow(clean(index), docs.schema)
    return docs
