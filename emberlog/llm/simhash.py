"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints of 64 bits are linked where they differ in ``NEAR`` bits or fewer. Correlated bits are grouped into partitions. For each
fingerprint a dynamic program spreads thresholds t over the partitions, each -1 or more, so that the t + 1 add up to ``NEAR`` + 1: then
any fingerprint within ``NEAR`` bits is within t bits in one of the partitions. It minimises candidates, estimated from the counts of
all fingerprints' values, and probes. Each fingerprint is listed under its own value of every partition and probes the values within
its thresholds; what meets under a value is verified by its differing bits.

Equal fingerprints are one entry. Values where many fingerprints meet are cut into a grid of blocks of bounded size, and a block
returns a spanning forest of its links, never its pairs. Components come from the links by alternating star contraction; every round
is written to the shared folder.

Defined results: null text counts as empty; texts of fewer than three words are one shingle; texts without words have fingerprint
zero and are linked like any other; documents with a null key share a component but never name it while another key does; repeated
rows are linked alike; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import fresh, shuffle_parts, staged, text_of

BITS, NEAR, WORDS, SEED = 64, 3, 3, 42
#: Fingerprints of one kind in a block. Shingles hashed, and entries made, at a time.
SIDE, CHUNK, ENTRIES = 256, 50_000, 500_000
#: Widest value that is counted exactly; wider partitions are estimated from the counts of their parts.
COUNTED = 16
INDEX, PROBE = 1, 2


def fingerprint(text: str) -> int:
    """The 64 bits, as an unsigned integer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    body, n = b" ".join(words), max(1, len(words) - WORDS + 1)
    ends = [0, *itertools.accumulate(len(w) + 1 for w in words)]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        many = min(CHUNK, n - at)
        hashes = np.array([digest(body[s : e - 1], SEED) for s, e in zip(ends[at : at + many], ends[at + WORDS :] or [len(body) + 1], strict=False)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(text.as_py()) for text in batch.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["key", "fp"])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fp`` of every row; the bits as a signed long."""
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), text_of(docs[text]).alias("text")).mapInArrow(_fingerprints, f"key {kind}, fp long")


# --- partitions and thresholds ------------------------------------------------------------------------------------


def _bits_of(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros((BITS, BITS))
    for batch in batches:
        bits = _bits_of(batch.column(0).to_numpy()).astype(np.float32)
        sums += bits.T @ bits
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS), pa.int32()), *(pa.array(column) for column in sums.T)], ["bit", *(f"c{k}" for k in range(BITS))])


def group_bits(moments: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits by partition, correlated ones together: each partition starts with the strongest pair left and takes the bit closest to it."""
    mean = np.diag(moments) / max(1, n)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    strength = np.abs((moments / max(1, n) - np.outer(mean, mean)) / np.outer(spread, spread))
    np.fill_diagonal(strength, -1.0)
    left, groups = set(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        mine = sorted(left)
        a, b = divmod(int(strength[np.ix_(mine, mine)].argmax()), len(mine))
        group = [mine[a], mine[b]]
        left -= set(group)
        while len(group) < width:
            mine = sorted(left)
            best = mine[int(strength[np.ix_(mine, group)].sum(axis=1).argmax())]
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def pieces_of(groups: list[list[int]]) -> list[tuple[int, list[int]]]:
    """Each partition's pieces of countable width: partition, bits."""
    return [(p, group[at : at + COUNTED]) for p, group in enumerate(groups) for at in range(0, len(group), COUNTED)]


def number_of_parts(n: int) -> int:
    """Two to four partitions, by the probes and candidates that even thresholds over evenly spread values would cost."""
    even = {4: [0, 0, 0, 0], 3: [1, 0, 0], 2: [1, 1]}

    def cost(parts: int) -> float:
        return sum(ball(BITS // parts, t) * (1 + n / 2 ** (BITS // parts)) for t in even[parts])

    return min(even, key=cost)


def ball(width: int, radius: int) -> int:
    return sum(math.comb(width, r) for r in range(radius + 1))


def shells(counts: np.ndarray, width: int) -> np.ndarray:
    """How many fingerprints have a value at distance 0, 1, ..., ``NEAR`` of each value."""
    out, values = np.zeros((NEAR + 1, len(counts))), np.arange(len(counts))
    out[0] = counts
    for bit in range(width):
        flipped = values ^ (1 << bit)
        out[1:] = out[1:] + out[:-1][:, flipped]
    return out


class Plan:
    """Partitions and estimates; what a task needs to place fingerprints."""

    def __init__(self, groups: list[list[int]], counts: list[np.ndarray], n: int):
        self.groups, self.pieces, self.n = groups, pieces_of(groups), max(1, n)
        self.shells = [shells(c, len(bits)) for c, (_, bits) in zip(counts, self.pieces, strict=True)]
        self.masks = {(p, r): self._masks(len(g), r) for p, g in enumerate(groups) for r in range(NEAR + 1)}

    @staticmethod
    def _masks(width: int, radius: int) -> np.ndarray:
        return np.array([sum(1 << b for b in bits) for r in range(radius + 1) for bits in itertools.combinations(range(width), r)], np.int64)

    def values(self, fps: np.ndarray, bits: list[int]) -> np.ndarray:
        out = np.zeros(len(fps), np.int64)
        for k, bit in enumerate(bits):
            out |= ((fps >> bit) & 1) << k
        return out

    def costs(self, fps: np.ndarray) -> np.ndarray:
        """Candidates and probes for each fingerprint, partition and threshold -1, 0, ..., ``NEAR``."""
        out = np.zeros((len(fps), len(self.groups), NEAR + 2))
        for p, group in enumerate(self.groups):
            total = None
            for (q, bits), table in zip(self.pieces, self.shells, strict=True):
                if q == p:
                    own = table[:, self.values(fps, bits)] / self.n
                    total = own if total is None else np.stack([sum(total[a] * own[r - a] for a in range(r + 1)) for r in range(NEAR + 1)])
            out[:, p, 1:] = (np.cumsum(total, axis=0) * self.n).T + [ball(len(group), r) for r in range(NEAR + 1)]
        return out

    def thresholds(self, fps: np.ndarray) -> np.ndarray:
        """The cheapest thresholds whose t + 1 add up to ``NEAR`` + 1, by dynamic programming over the partitions."""
        costs, need = self.costs(fps), NEAR + 1
        best = np.full((len(fps), need + 1), np.inf)
        best[:, 0] = 0
        chosen = []
        for p in range(len(self.groups)):
            new, pick = np.full_like(best, np.inf), np.zeros(best.shape, np.int64)
            for have in range(need + 1):
                for add in range(have + 1):
                    cost = best[:, have - add] + costs[:, p, add]
                    better = cost < new[:, have]
                    new[better, have], pick[better, have] = cost[better], add
            best = new
            chosen.append(pick)
        out, have = np.zeros((len(fps), len(self.groups)), np.int64), np.full(len(fps), need)
        for p in range(len(self.groups) - 1, -1, -1):
            out[:, p] = chosen[p][np.arange(len(fps)), have]
            have = have - out[:, p]
        return out - 1

    def entries(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``bucket, fp, kind``: where each fingerprint is listed and where it probes."""
        for batch in batches:
            everything = batch.column(0).to_numpy()
            for at in range(0, len(everything), 2000):
                fps = everything[at : at + 2000]
                limit = self.thresholds(fps)
                for p, group in enumerate(self.groups):
                    values, base = self.values(fps, group), np.int64(p) << 60
                    for t in range(-1, NEAR + 1):
                        some = np.flatnonzero(limit[:, p] == t)
                        masks = self.masks[p, max(t, 0)]
                        kind = np.where(masks == 0, INDEX | (PROBE if t >= 0 else 0), PROBE).astype(np.int32)
                        for part in np.array_split(some, -(-len(some) * len(masks) // ENTRIES)) if len(some) else ():
                            bucket = base | (values[part][:, None] ^ masks[None, :])
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(bucket.reshape(-1)), pa.array(np.repeat(fps[part], len(masks))), pa.array(np.tile(kind, len(part)))], ["bucket", "fp", "kind"]
                            )


def plan_of(distinct: DataFrame) -> Plan:
    """Partitions and counts from all fingerprints; at most 4 x 2**16 counts and 64 sums reach the driver."""
    sums = [f"c{k}" for k in range(BITS)]
    rows = distinct.select("fp").mapInArrow(_moments, "bit int, " + ", ".join(f"{c} double" for c in sums)).groupBy("bit").agg(*[F.sum(c).alias(c) for c in sums]).collect()
    moments, n = np.zeros((BITS, BITS)), distinct.count()
    for r in rows:
        moments[r["bit"]] = r[1:]
    groups = group_bits(moments, n, number_of_parts(n))
    pieces = pieces_of(groups)
    value = [sum(((F.shiftright("fp", bit).bitwiseAND(F.lit(1))) * F.lit(1 << k) for k, bit in enumerate(bits)), F.lit(0)).cast("int") for _, bits in pieces]
    seen = distinct.select(F.explode(F.array(*[F.struct(F.lit(k).alias("piece"), v.alias("value")) for k, v in enumerate(value)])).alias("x")).select("x.*")
    found = seen.groupBy("piece", "value").agg(F.count("*").alias("n")).toArrow()
    counts = [np.zeros(1 << len(bits)) for _, bits in pieces]
    piece, at, many = (found.column(c).to_numpy() for c in ("piece", "value", "n"))
    for k in range(len(pieces)):
        counts[k][at[piece == k]] = many[piece == k]
    return Plan(groups, counts, n)


# --- links --------------------------------------------------------------------------------------------------------


def spanning_links(block: np.ndarray, fps: np.ndarray, near: int = NEAR) -> np.ndarray:
    """Links (fingerprint, root) that connect, within each run of equal ``block``, all fingerprints within ``near`` bits of each other."""
    n = len(fps)
    at, left, right = np.arange(n), [], []
    for step in range(1, n):
        at = at[at + step < n]
        at = at[block[at] == block[at + step]]
        if not len(at):
            break
        close = at[np.bitwise_count((fps[at] ^ fps[at + step]).view(np.uint64)) <= near]
        left.append(close)
        right.append(close + step)
    if not left:
        return np.zeros((0, 2), np.int64)
    a, b, root = np.concatenate(left), np.concatenate(right), np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    while (root[root] != root).any():
        root = root[root]
    linked = np.flatnonzero(fps != fps[root])
    return np.unique(np.stack([fps[linked], fps[root[linked]]], axis=1), axis=0)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block; a block that goes on in the next batch waits for it."""
    block, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def links(upto: int) -> pa.RecordBatch:
        found = spanning_links(block[:upto], fps[:upto])
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    for batch in batches:
        block, fps = np.concatenate([block, batch.column(0).to_numpy()]), np.concatenate([fps, batch.column(1).to_numpy()])
        upto = int(np.searchsorted(block, block[-1])) if len(block) else 0
        yield links(upto)
        block, fps = block[upto:], fps[upto:]
    yield links(len(block))


def links_of(distinct: DataFrame) -> DataFrame:
    """``a, b``: links between different fingerprints that connect every component."""
    parts = shuffle_parts(distinct.sparkSession)
    plan = plan_of(distinct)
    entries = staged(distinct.select("fp").mapInArrow(plan.entries, "bucket long, fp long, kind int"), "entries")
    listed, asked = F.col("kind").bitwiseAND(F.lit(INDEX)) > 0, F.col("kind").bitwiseAND(F.lit(PROBE)) > 0
    buckets = entries.groupBy("bucket").agg(F.count_if(listed).alias("lists"), F.count_if(asked).alias("asks"), F.count("*").alias("rows"))
    buckets = buckets.where((F.col("lists") > 0) & (F.col("asks") > 0) & (F.col("rows") > 1))
    met = entries.join(buckets, "bucket").withColumns({"down": F.ceil(F.col("lists") / SIDE).cast("int"), "across": F.ceil(F.col("asks") / SIDE).cast("int")})
    cut = (F.col("down") > 1) | (F.col("across") > 1)
    own = F.xxhash64("fp")
    rows = F.explode(F.sequence(F.lit(0), F.col("across") - 1))
    columns = F.explode(F.sequence(F.lit(0), F.col("down") - 1))
    small = met.where(~cut).select(F.xxhash64("bucket").alias("block"), "fp")
    down = met.where(cut & listed).select("bucket", F.pmod(own, "down").cast("int").alias("i"), rows.alias("j"), "fp")
    across = met.where(cut & asked).select("bucket", columns.alias("i"), F.pmod(own, "across").cast("int").alias("j"), "fp")
    blocks = small.unionByName(down.unionByName(across).select(F.xxhash64("bucket", "i", "j").alias("block"), "fp"))
    return blocks.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(_verify, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``fp, root``: every linked fingerprint and the least one of its component, by alternating star contraction."""
    edges = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0).cast("decimal(20,0)"))).first()

    before = mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = staged(large, "large-star")
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        edges = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = staged(edges.where(F.col("a") != F.col("b")).distinct(), "small-star")
        now = mark(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("fp"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``<key>, fingerprint, component_id``."""
    fps = staged(fingerprints(docs, key, text), "fingerprints")
    distinct = staged(fps.groupBy("fp").agg(F.min("key").alias("first")), "distinct")
    rooted = distinct.join(components(links_of(distinct)), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.select("fp", "root").join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    out = fps.join(named, "fp")
    return out.select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: those with the smallest key of their component."""
    (stays,) = fresh("stays")
    stay = near_duplicates(docs, key, text).where(F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias(stays)).distinct()
    return docs.join(stay, docs[key].eqNullSafe(F.col(stays)), "left_semi")
