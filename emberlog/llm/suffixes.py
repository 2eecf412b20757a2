"""Suffix arrays and content-defined anchors of byte strings, in numpy."""

from __future__ import annotations

import numpy as np

#: Length of a repeat; bytes of an anchor's gram; zero bytes between the documents of a shard, enough for an anchor's context.
SPAN, GRAM, GAP = 50, 12, 64
#: Bytes before an anchor that a window around it can reach, and half of them: every window around an anchor holds all bytes from the
#: anchor to ``SPAN - HALF`` after it, or all from ``HALF`` before it to its gram's end.
LEFT = SPAN - GRAM
HALF = LEFT // 2
#: Bits of the table that tells windows alone in a shard from others.
SLOTS = 24


def join_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one buffer with gaps between, their starts and ends."""
    gap = bytes(GAP)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = GAP + np.concatenate([[0], np.cumsum(sizes + GAP)[:-1]]) if len(texts) else np.zeros(0, np.int64)
    return np.frombuffer(gap + gap.join(texts) + gap, np.uint8), starts.astype(np.int64), (starts + sizes).astype(np.int64)


def words_at(buffer: np.ndarray, n: int, kind: str = "<u8") -> np.ndarray:
    """The eight bytes at each of the first ``n`` positions, as integers."""
    return np.ndarray((n,), kind, buffer, 0, (1,))


def repeating(buffer: np.ndarray, at: np.ndarray, size: int = SPAN) -> np.ndarray:
    """Those of the positions whose ``size`` bytes may occur at another one, by a 64-bit hash: equal bytes are never left out."""
    n = max(0, len(buffer) - size)
    words = words_at(buffer, n + size - 8)
    every = np.zeros(n, np.uint64)
    for k in [*range(0, size - 8, 8), size - 8]:
        every *= np.uint64(0xD1342543DE82EF95)
        every += words[k : k + n]
    every ^= every >> np.uint64(29)
    every *= np.uint64(0x9E3779B97F4A7C15)
    h = every[at]
    del every
    ordered = np.sort(h)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    del ordered
    if not len(twice):
        return at[:0]
    # a table of upper bits tells most of the others; those it lets through are looked up
    table = np.zeros(1 << SLOTS, bool)
    table[(twice >> np.uint64(64 - SLOTS)).astype(np.int64)] = True
    some = np.flatnonzero(table[(h >> np.uint64(64 - SLOTS)).astype(np.int64)])
    place = np.minimum(np.searchsorted(twice, h[some]), len(twice) - 1)
    return at[some[twice[place] == h[some]]]


def suffix_order(buffer: np.ndarray, at: np.ndarray, depth: int = 64) -> np.ndarray:
    """Larsson-Sadakane refinement: those of the positions that share their first ``depth`` / 2 bytes or more with another one, in the
    order of their first ``depth`` bytes.

    Ranks by eight bytes come from one sort; each round doubles the bytes a rank stands for by sorting pairs of ranks (its own and
    that of the suffix as many bytes on), and only within groups of more than one. Suffixes alone in their group are final: no
    other suffix shares their prefix, so they are left out of later rounds. Only the positions and the ``depth`` - 8 after each are
    ranked: no rank within ``depth`` bytes of a position asks for more.
    """
    n = len(buffer)
    step = np.zeros(n + 1, np.int32)
    step[at] += 1
    np.subtract.at(step, np.minimum(at + depth - 7, n), 1)
    near = np.flatnonzero(np.cumsum(step[: n - 8]) > 0)
    keys = words_at(buffer, n - 8, ">u8")[near].astype(np.uint64)
    order = np.argsort(keys)
    keys = keys[order]
    order = near[order]
    new = np.empty(len(order), bool)
    new[:1] = True
    new[1:] = keys[1:] != keys[:-1]
    rank = np.zeros(n, np.int64)
    first = np.flatnonzero(new)
    rank[order] = np.repeat(first, np.diff(np.append(first, len(order))))  # where a group begins in the sorted order
    live = np.zeros(n, bool)
    live[at] = True
    reach = 8
    group = rank[order]
    alone = new & np.append(new[1:], True)
    order, group = order[~alone], group[~alone]
    while reach < depth and len(order):
        pair = (group << 32) | rank[np.minimum(order + reach, n - 1)]
        by = np.argsort(pair)
        order, pair, old = order[by], pair[by], group[by]
        new = np.empty(len(order), bool)
        new[:1] = True
        new[1:] = pair[1:] != pair[:-1]
        first = np.flatnonzero(new)
        head = np.repeat(first, np.diff(np.append(first, len(order))))
        outer = np.empty(len(order), bool)
        outer[:1] = True
        outer[1:] = old[1:] != old[:-1]
        begin = np.flatnonzero(outer)
        group = old + head - np.repeat(begin, np.diff(np.append(begin, len(order))))
        rank[order] = group
        reach *= 2
        if reach < depth:
            alone = new & np.append(new[1:], True)
            order, group = order[~alone], group[~alone]
    return order[live[order]]


def common_prefixes(buffer: np.ndarray, order: np.ndarray, cap: int = SPAN) -> np.ndarray:
    """What each suffix in ``order`` shares with the one before it, up to ``cap`` bytes.

    All pairs of neighbours are compared from their first byte, eight bytes at a time; nothing is carried over as in Kasai's method.
    """
    prior = np.concatenate([order[:1], order[:-1]])
    in_text = np.argsort(order)
    here, there = order[in_text], prior[in_text]
    shared, open_ = np.zeros(len(order), np.int64), np.arange(len(order))
    for at in range(0, cap, 8):
        if not len(open_):
            break
        n = len(buffer) - 8
        a, b = words_at(buffer, n)[np.minimum(here[open_] + at, n - 1)], words_at(buffer, n)[np.minimum(there[open_] + at, n - 1)]
        differ = a ^ b
        low = differ & (~differ + np.uint64(1))
        equal = np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8).astype(np.int64)
        shared[open_] += equal
        open_ = open_[equal == 8]
    out = np.zeros(len(order), np.int64)
    out[in_text] = np.minimum(shared, cap)
    out[:1] = 0
    return out


def owners(starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(starts, at, side="right") - 1


def window_starts(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Where a window of ``SPAN`` bytes lies within one document, as a mask over the buffer."""
    step = np.zeros(n + 1, np.int64)
    some = ends - starts >= SPAN
    np.add.at(step, starts[some], 1)
    np.add.at(step, ends[some] - SPAN + 1, -1)
    return np.cumsum(step[:-1]) > 0


def repeated_windows(buffer: np.ndarray, starts: np.ndarray, valid: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Starts of the windows that also begin in a document of the buffer with a smaller rank, by the buffer's suffix array."""
    order = suffix_order(buffer, repeating(buffer, np.flatnonzero(valid)))
    if not len(order):
        return order
    new = common_prefixes(buffer, order) < SPAN
    rank = ranks[owners(starts, order)]
    first = np.flatnonzero(new)
    least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(order))))
    return order[rank > least]


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of each integer spread over all of it."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def span_hash(buffer: np.ndarray, at: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes, 8 or more, at each position."""
    words, out = words_at(buffer, len(buffer) - 8), np.full(len(at), seed, np.uint64)
    for k in [*range(0, size - 8, 8), size - 8]:
        out = mixed(out + words[at + k])
    return out


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` over the ``width`` values from each place on."""
    reach = 1
    while reach * 2 <= width:
        x = np.append(best(x[:-reach], x[reach:]), x[-reach:])
        reach *= 2
    rest = width - reach
    return np.append(best(x[:-rest], x[rest:]), x[-rest:]) if rest else x


def anchors(buffer: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of the wanted windows: in each window the grams with the least hash.

    Equal windows have equal anchors at equal places, whatever stands around them.
    """
    n = len(buffer) - GAP
    words = words_at(buffer, n + 8)
    grams = mixed(words[:n] + mixed(words[GRAM - 8 : n + GRAM - 8])) | np.uint64(1)  # 0 stands for no window
    least = _slide(grams, LEFT + 1, np.minimum)
    least[~wanted[:n]] = 0
    most = _slide(least[::-1], LEFT + 1, np.maximum)[::-1]
    at = np.flatnonzero(most == grams)
    return at, grams[at]


def contexts(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of what windows around each anchor can see, 64 bits of all of it (``LEFT`` before to ``SPAN`` after, within the
    document) and 16 bits of either part that half of the windows hold whole."""
    owner = owners(starts, at)
    left, right = np.minimum(at - starts[owner], LEFT), np.minimum(ends[owner] - at, SPAN)
    seen = mixed(span_hash(buffer, at - LEFT, LEFT + SPAN, 5) + (left * 64 + right).astype(np.uint64))
    return seen, span_hash(buffer, at, SPAN - HALF, 7) >> np.uint64(48), span_hash(buffer, at - HALF, HALF + GRAM, 9) >> np.uint64(48)


def covered(n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A mask over ``n`` bytes of what the intervals cover."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.clip(begin, 0, n), 1)
    np.add.at(step, np.clip(end, 0, n), -1)
    return np.cumsum(step[:-1]) > 0
