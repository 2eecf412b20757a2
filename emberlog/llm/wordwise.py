"""Encode texts with a tokenizer of the tokenizers library, word by word where that gives the same ids.

A byte-level pre-tokenizer starts a new piece at a lone space, and at a lone line end, between two characters that are no white
space, so the ids of such a text are those of its words, each with the space or line end before it. A run of texts is split and
dictionary-encoded in Arrow; each distinct word is encoded once and all ids are gathered by their places. New words are encoded
as one text of words with a space before each: the tokens that begin with a space or line end tell where each word begins. Words are kept
in a cache of bounded bytes.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of the words that are kept, some of them for the entry; bytes of the texts that are split at a time.
KEPT, ENTRY, RUN = 64_000_000, 160, 2_000_000
#: White space other than the space and the line end.
OTHER = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
#: Texts that are cut only at a lone space between characters that are no white space.
ROUGH = rf"\A[ \n]|[ \n]\z|[ \n][ \n]|[{OTHER}]"
LONE = re.compile(r"(?<=\S) (?=\S)")
#: Stands before the first word of a text, which has no space.
FIRST = "\r"

_encoders: dict[str, Callable[[pa.Array], Iterator[np.ndarray]]] = {}


def tokenizer_file(name: str) -> str:
    """A path as it is; a bare name is that of an installed public vocabulary."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _splits_at_spaces(spec: dict) -> bool:
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    return plain and spec.get("normalizer") is None and model.get("type") == "BPE" and not model.get("dropout")


def encoder(name: str) -> Callable[[pa.Array], Iterator[np.ndarray]]:
    """A function from an array of texts to the ids of each; a Python worker makes one for each tokenizer."""
    if name not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_file(name))

        def whole(texts: pa.Array) -> Iterator[np.ndarray]:
            for text in texts:
                yield np.array(tokenizer.encode(text.as_py(), add_special_tokens=False).ids, "<u4")

        spec = json.loads(tokenizer.to_str())
        _encoders[name] = Words(tokenizer, spec, whole).encode if _splits_at_spaces(spec) else whole
    return _encoders[name]


def _runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of runs, one run after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)


class Words:
    """The ids of words, kept in one array with each word's place and number."""

    def __init__(self, tokenizer, spec: dict, whole: Callable[[pa.Array], Iterator[np.ndarray]]):
        self.tokenizer, self.whole = tokenizer, whole
        self.marks = "|".join(re.escape(added["content"]) for added in spec.get("added_tokens", []))
        vocabulary = tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        # a byte-level vocabulary spells the space and the line end as these letters
        self.begins[[number for token, number in vocabulary.items() if token[:1] in ("Ġ", "Ċ")]] = True
        spelled = {sign: tokenizer.encode(sign, add_special_tokens=False).ids for sign in ".,"}
        self.signs = {sign: ids[0] for sign, ids in spelled.items() if len(ids) == 1}
        self.forget()

    def forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.ids, self.at, self.size, self.held = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def add(self, words: Sequence[str], ids: np.ndarray, size: np.ndarray) -> None:
        self.slot.update(zip(words, range(len(self.size), len(self.size) + len(words)), strict=True))
        self.at = np.append(self.at, len(self.ids) + np.cumsum(size) - size)
        self.ids, self.size = np.append(self.ids, ids), np.append(self.size, size)
        self.held += sum(map(len, words)) + ENTRY * len(words) + 4 * len(ids)

    def spell(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, each encoded as a text."""
        texts = [w[1:] if w.startswith(FIRST) else w if w.startswith("\n") else " " + w for w in words]
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter((i for ids in found for i in ids), "<u4"), np.fromiter(map(len, found), np.int64, len(found))

    def spell_joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words that hold no white space but a line end in front, encoded as one text."""
        text = " " + " ".join(words).replace(" \n", "\n") if words and words[0][0] != "\n" else " ".join(words).replace(" \n", "\n")
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4") if words else np.zeros(0, "<u4")
        first = np.flatnonzero(self.begins[ids])
        if len(first) != len(words):
            return self.spell(words)
        return ids, np.diff(np.append(first, len(ids)))

    def learn(self, words: list[str], loose: set[str]) -> None:
        """Keep the ids of new words; a word of letters and the sign after it are two pieces, so the bare word serves both."""
        bare = {word: word[:-1] for word in words if word[-1] in self.signs and word[:-1].isalpha()}
        parts = [part for part in dict.fromkeys(bare.get(word, word) for word in words) if part not in self.slot]
        alone = [part for part in parts if part[0] == FIRST or part in loose]
        plain = [part for part in parts if part[0] != FIRST and part not in loose]
        self.add(plain, *self.spell_joined(plain))
        self.add(alone, *self.spell(alone))
        own = np.array([self.slot[part] for part in bare.values()], np.int64)
        size = self.size[own] + 1
        last = np.cumsum(size) - 1
        ids = np.zeros(size.sum(), "<u4")
        ids[last] = [self.signs[word[-1]] for word in bare]
        ids[np.delete(np.arange(len(ids)), last)] = self.ids[_runs(self.at[own], self.size[own])]
        self.add(list(bare), ids, size)

    def gather(self, words: pa.Array, loose: set[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in order, and each word's number of them."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        self.learn([word for word in distinct if word not in self.slot], loose)
        own = np.array([self.slot[word] for word in distinct], np.int64)[coded.indices.to_numpy()]
        return self.ids[_runs(self.at[own], self.size[own])], self.size[own]

    def _split(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of texts that hold no special token."""
        rough = pc.match_substring_regex(texts, ROUGH)
        plain = pc.binary_join_element_wise(pa.scalar(FIRST, texts.type), texts.filter(pc.invert(rough)), pa.scalar("", texts.type))
        lists = pc.split_pattern(pc.replace_substring(plain, "\n", " \n"), " ")
        cut = [LONE.split(text) for text in texts.filter(rough).to_pylist()]
        rest = [word for first, *more in cut for word in (FIRST + first, *more)]
        ids, size = self.gather(pa.concat_arrays([lists.flatten(), pa.array(rest, texts.type)]), set(rest))
        words = np.concatenate([pc.list_value_length(lists).to_numpy(), np.fromiter(map(len, cut), np.int64, len(cut))])
        ends = np.append(0, np.cumsum(size))[np.cumsum(words)]
        begin = np.append(0, ends[:-1])
        # plain texts come first: back to the order given
        place = np.argsort(np.argsort(rough.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
        for k in place:
            yield ids[begin[k] : ends[k]]
        if self.held > KEPT:
            self.forget()

    def _run(self, texts: pa.Array) -> Iterator[np.ndarray]:
        if not self.marks or not pc.any(marked := pc.match_substring_regex(texts, self.marks)).as_py():
            yield from self._split(texts)
            return
        whole, split = self.whole(texts.filter(marked)), self._split(texts.filter(pc.invert(marked)))
        for found in marked.to_pylist():
            yield next(whole if found else split)

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, a run of texts at a time."""
        ends = np.cumsum(pc.binary_length(texts).to_numpy())
        cuts = np.flatnonzero(np.diff(ends // RUN, prepend=0))
        for begin, end in zip([0, *cuts + 1], [*cuts + 1, len(texts)], strict=True):
            if end > begin:
                yield from self._run(texts.slice(begin, end - begin))
