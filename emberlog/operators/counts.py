"""One pass over parsed records: counts by pattern and, in the same pass, the first examples of every pattern.

Each task sums up its records in bounded memory and hands on one row per pattern it met (more if it met very many), with at most
``EXAMPLES_KEPT`` examples of least position. These rows are written to the shared checkpoint folder; groups, ranks, insights,
summary and examples all read them, so the logs are read once for everything.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.session import staged

EXAMPLES_KEPT = 3
KEYS = ("scope", "is_error", "pattern", "level", "service", "source_type")
#: Patterns, and characters of examples, that a task holds before it hands them on.
HELD_GROUPS, HELD_TEXT = 100_000, 64 << 20


def count_patterns(patterned: DataFrame, examples: bool = True) -> DataFrame:
    """``scope, is_error, pattern, level, service, source_type, n, n_lines, first_pos, examples``, written once.

    A combination may have several rows, which add up. Without ``examples`` no record leaves the JVM, and the column is empty.
    """
    pos = patterned.schema["pos"].dataType
    listed = T.ArrayType(T.StructType([T.StructField("pos", pos), T.StructField("raw", T.StringType())]))
    if not examples:
        counted = patterned.groupBy(*KEYS).agg(F.count("*").alias("n"), F.sum("n_lines").alias("n_lines"), F.min("pos").alias("first_pos"))
        return staged(counted.withColumn("examples", F.lit(None).cast(listed)), "patterns")
    fields = [patterned.schema[k] for k in KEYS] + [T.StructField(c, T.LongType()) for c in ("n", "n_lines")]
    schema = T.StructType([*fields, T.StructField("first_pos", pos), T.StructField("examples", listed)])
    shown = F.when(F.col("is_error"), F.col("raw"))  # only failures are shown
    rows = patterned.select(*KEYS, F.col("n_lines").cast("long").alias("n_lines"), "pos", shown.alias("raw"))
    return staged(rows.mapInArrow(_counted, schema), "patterns")


def _counted(batches: Iterator) -> Iterator:
    """Sum up batches: group numbers by dictionaries of the key columns, first places by one sort of the batch."""
    import numpy as np
    import pyarrow as pa

    held: dict[tuple, list] = {}  # key -> [n, n_lines, [(place, pos, raw), ...]]
    text, types = 0, None

    def emit():
        columns = list(zip(*held, strict=True))
        sums = list(held.values())
        first = [entry[2][0][1] for entry in sums]
        shown = [[{"pos": pos, "raw": raw} for _, pos, raw in entry[2]] if key[1] else [] for key, entry in held.items()]
        values = [*columns, [entry[0] for entry in sums], [entry[1] for entry in sums], first, shown]
        names = [*KEYS, "n", "n_lines", "first_pos", "examples"]
        kinds = [*types[:6], pa.int64(), pa.int64(), types[7], pa.list_(pa.struct([("pos", types[7]), ("raw", types[8])]))]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        types = [batch.column(i).type for i in range(9)]
        group = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns[: len(KEYS)]:
            coded = column.dictionary_encode(null_encoding="encode")
            group = group * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False)
            group = np.unique(group, return_inverse=True)[1]
        size = int(group.max()) + 1
        n, n_lines = np.bincount(group, minlength=size), np.zeros(size, np.int64)
        np.add.at(n_lines, group, batch.column(6).to_numpy(zero_copy_only=False))
        order = _by_place(batch.column(7))
        order = order[np.argsort(group[order], kind="stable")]
        rank = np.arange(len(order)) - np.searchsorted(group[order], group[order])
        error = batch.column(1).to_numpy(zero_copy_only=False)
        picked = order[rank < np.where(error[order], EXAMPLES_KEPT, 1)]
        some = batch.take(pa.array(picked))
        keys = list(zip(*(column.to_pylist() for column in some.columns[: len(KEYS)]), strict=True))
        for at, key, pos, raw in zip(group[picked].tolist(), keys, some.column(7).to_pylist(), some.column(8).to_pylist(), strict=True):
            entry = held.setdefault(key, [0, 0, []])
            entry[0] += int(n[at])
            entry[1] += int(n_lines[at])
            n[at] = n_lines[at] = 0  # counted with the first of the group's rows
            kept = entry[2]
            kept.append((_place(pos), pos, raw))
            kept.sort(key=lambda x: x[0])
            text += len(raw or "") + len(key[2] or "")
            for _, _, dropped in kept[EXAMPLES_KEPT if key[1] else 1 :]:
                text -= len(dropped or "")
            del kept[EXAMPLES_KEPT if key[1] else 1 :]
        if len(held) > HELD_GROUPS or text > HELD_TEXT:
            yield emit()
            held, text = {}, 0
    if held:
        yield emit()


def _by_place(pos):
    """Row numbers in the order of a column that is a number, a text, a time, or a struct of such."""
    import pyarrow as pa
    import pyarrow.compute as pc

    leaves = []

    def flat(column):
        if pa.types.is_struct(column.type):
            for part in column.flatten():
                flat(part)
        else:
            leaves.append(column)

    flat(pos)
    table = pa.table({str(i): leaf for i, leaf in enumerate(leaves)})
    keys = [(str(i), "ascending") for i in range(len(leaves))]
    return pc.sort_indices(table, sort_keys=keys, null_placement="at_start").to_numpy()


def _place(pos):
    """A position as something that compares like Spark's order, nulls first."""
    if isinstance(pos, dict):
        return tuple(_place(v) for v in pos.values())
    return (pos is not None, pos)
