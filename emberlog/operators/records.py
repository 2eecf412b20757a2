"""Lines to records: continuation lines join the record before them.

Three physical shapes with the same result:

* ``records_from_text``: the whole text sits in one column, so records are cut by one regex split. No shuffle.
* ``records_from_files``: each scan task joins the lines of its own file splits in order. No shuffle of the text: the pieces
  are written once, and only the first and last piece of each split (two rows per split) are stitched across splits.
* ``records_from_lines``: one line per row with an order column. Lines are shuffled once, in bounded ranges of the
  order column, so a scope holding most of the rows is spread over many tasks; range edges are stitched as above.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.functions.plan import settled
from emberlog.functions.text import ANY_LINE_END, LINE_END, WS_CLASS, rstrip, rstrip_column, unicode_re
from emberlog.session import staged

# What a continuation line starts with, apart from a blank or a tab.
CONTINUATION_HEAD = (
    r"at[^\S\n]|Caused by:|Suppressed:|Traceback \(most recent call last\):|File \"|During handling"
    r"|The above exception|\.\.\. \d+ more|(?:DETAIL|HINT|STATEMENT|CONTEXT|QUERY):[^\S\n]"
)
CONTINUATION = rf"(?:[ \t]|{WS_CLASS}*(?:{CONTINUATION_HEAD}))"


def is_continuation(line: Column) -> Column:
    """Whether a right-stripped line carries on the record before it."""
    return line.rlike(unicode_re(rf"\A{CONTINUATION}"))


def dense_text(text: Column) -> Column:
    """The text with ``\\n`` line ends, without blank lines and without blanks at line ends."""
    lines = F.regexp_replace(text, LINE_END, "\n")
    # A white-space run that holds a line end (trailing blanks, blank lines, the end itself) becomes one end.
    run = rf"(?<!{WS_CLASS}){WS_CLASS}*\n"
    return F.ltrim(rstrip(F.regexp_replace(lines, unicode_re(run), "\n")), F.lit("\n"))


def record_array(text: Column) -> Column:
    """Array of records of a text. Blank lines are dropped and do not end a record."""
    records = F.split(dense_text(text), unicode_re(rf"\n(?!{CONTINUATION})"), -1)
    return F.filter(records, lambda r: r != "")


def line_count(raw: Column) -> Column:
    """Number of lines of a record (they are never blank and end in ``\\n``)."""
    return (F.length(raw) - F.length(F.replace(raw, F.lit("\n"))) + 1).cast("bigint")


def records_from_text(df: DataFrame, text: str, scope: str | Column, order: str | Column | None = None) -> DataFrame:
    """Records of a text column. ``order`` orders the rows when several rows share a scope."""
    scope = F.col(scope) if isinstance(scope, str) else scope
    order = F.col(order) if isinstance(order, str) else order
    keep = [scope.cast("string").alias("scope")]
    if order is not None:
        keep.append(order.alias("__order"))
    out = df.select(*keep, F.posexplode(record_array(F.col(text))).alias("__n", "raw"))
    number = F.col("__n").cast("bigint")
    pos = number if order is None else F.struct(F.col("__order").alias("row"), number.alias("n"))
    return out.select("scope", pos.alias("pos"), "raw", line_count(F.col("raw")).alias("n_lines"))


def records_from_rows(df: DataFrame, record: str, scope: str | Column, order: str | Column) -> DataFrame:
    """Rows that already hold one record each, such as messages of a log topic."""
    scope = F.col(scope) if isinstance(scope, str) else scope
    order = F.col(order) if isinstance(order, str) else order
    # A row of one line, the common case, is not searched for blank lines; the row's text is read twice, so it is a step of its own.
    rows = df.select(scope.cast("string").alias("scope"), order.alias("pos"), settled(F.col(record)).alias("raw"))
    text = F.col("raw")
    raw = F.when(text.rlike(ANY_LINE_END), dense_text(text)).otherwise(rstrip_column(text))
    out = rows.select("scope", "pos", settled(raw).alias("raw")).where("raw <> ''")
    return out.withColumn("n_lines", line_count(F.col("raw")))


def records_from_lines(lines: DataFrame, chunk: Column) -> DataFrame:
    """Records of ``lines(scope, pos, line)``.

    ``chunk`` must be constant over bounded, contiguous ranges of ``pos`` within a scope, e.g.
    ``(pos / 1000000).cast('bigint')``. It spreads one large scope over many tasks.
    """
    line = rstrip_column(F.col("line"))
    marked = (
        lines.select("scope", "pos", line.alias("line"), chunk.alias("__chunk"))
        .where("line <> ''")
        .withColumn("__start", ~is_continuation(F.col("line")))
    )
    in_chunk = Window.partitionBy("scope", "__chunk")
    start = F.when(F.col("__start"), F.col("pos"))
    running = in_chunk.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = (
        marked.withColumn("__record", F.last(start, ignorenulls=True).over(running))
        .withColumn("__last", F.max(start).over(in_chunk))
        .groupBy("scope", "__chunk", "__record", "__last")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("__lines"))
        .select(
            "scope",
            F.col("__lines")[0]["pos"].alias("pos"),
            F.array_join(F.col("__lines")["line"], "\n").alias("raw"),
            F.size("__lines").cast("bigint").alias("n_lines"),
            F.col("__record").isNull().alias("head"),
            (F.col("__record") == F.col("__last")).alias("tail"),
        )
    )
    return stitch(parts)


def records_from_files(lines: DataFrame, per_file: bool = True) -> DataFrame:
    """Records of ``lines(scope, path, block, line)`` in scan order, as ``sources.text.file_lines`` gives them.

    ``per_file`` says that each file is a scope of its own: ``pos`` is then one BIGINT, else the path leads.
    """
    marked = (
        lines.select("scope", "path", "block", rstrip_column(F.col("line")).alias("line"))
        .where("line <> ''")
        .withColumn("start", ~is_continuation(F.col("line")))
    )
    parts = marked.mapInArrow(join_split_lines, PARTS_SCHEMA)
    pos = F.col("n") if per_file else F.struct("path", "n")
    return stitch(parts.withColumn("pos", pos))


def stitch(parts: DataFrame) -> DataFrame:
    """Join the leading continuation piece of a range to the last record of the range before it.

    The pieces are written once to the shared checkpoint folder, range edges (at most two a range) apart from all others, so what is
    costly above runs once and the edges are found without reading the rest. Which record an edge belongs to is told by its place
    alone: the one ordered pass of a scope sees two short rows a range and no text. The text then meets record by record.
    """
    columns = ["scope", "pos", "raw", "n_lines"]
    held = staged(parts.select(*columns, "head", (F.col("head") | F.col("tail")).alias("edge")), "pieces", by="edge")
    inner = held.where(~F.col("edge")).select(*columns)
    edges = held.where(F.col("edge"))
    running = Window.partitionBy("scope").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owner = F.last(F.when(~F.col("head"), F.col("pos")), ignorenulls=True).over(running)
    places = edges.select(F.col("scope").alias("__scope"), F.col("pos").alias("__pos"), owner.alias("__record"))
    stitched = (
        edges.join(places, F.col("scope").eqNullSafe(F.col("__scope")) & (F.col("pos") == F.col("__pos")))
        .groupBy("scope", "__record")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "raw", "n_lines"))).alias("__parts"))
        .select(
            "scope",
            F.col("__parts")[0]["pos"].alias("pos"),
            F.array_join(F.col("__parts")["raw"], "\n").alias("raw"),
            F.aggregate(F.col("__parts")["n_lines"], F.lit(0).cast("bigint"), lambda a, n: a + n).alias("n_lines"),
        )
    )
    return inner.unionByName(stitched)


PARTS_SCHEMA = T.StructType(
    [
        T.StructField("scope", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("raw", T.StringType()),
        T.StructField("n_lines", T.LongType()),
        T.StructField("head", T.BooleanType()),
        T.StructField("tail", T.BooleanType()),
    ]
)


def join_split_lines(batches: Iterator) -> Iterator:
    """Join the ordered lines of each file split to records, one Arrow batch at a time.

    The open record is carried from batch to batch. A split of ``b`` bytes at offset ``o`` has at most ``b`` lines
    (``b + 1`` for the first), so ``o + line number`` (plus one after the first split) is unique and ascending in a file.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    split = None  # (scope, path, block) of the open record
    open_lines: list[str] = []
    open_head = False
    open_at = 0
    seen = 0  # lines of the split so far

    def offset(at: int) -> int:
        return split[2] + at + (1 if split[2] > 0 else 0)

    def emit(starts_at, raws, counts, heads, tails):
        size = len(raws)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([split[0]] * size, pa.string()),
                pa.array([split[1]] * size, pa.string()),
                pa.array([offset(int(a)) for a in starts_at], pa.int64()),
                pa.array(raws, pa.string()) if isinstance(raws, list) else raws.cast(pa.string()),
                pa.array(counts, pa.int64()),
                pa.array(heads, pa.bool_()),
                pa.array(tails, pa.bool_()),
            ],
            names=[f.name for f in PARTS_SCHEMA.fields],
        )

    def close(tail: bool):
        return emit([open_at], ["\n".join(open_lines)], [len(open_lines)], [open_head], [tail and not open_head])

    for batch in batches:
        if batch.num_rows == 0:
            continue
        scope, path, block, line, start = (batch.column(i) for i in range(5))
        block_np = block.to_numpy(zero_copy_only=False)
        path_codes = path.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        change = np.flatnonzero((np.diff(block_np) != 0) | (np.diff(path_codes) != 0)) + 1
        for lo, hi in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
            here = (scope[lo].as_py(), path[lo].as_py(), int(block_np[lo]))
            if here != split:
                if open_lines:
                    yield close(tail=True)
                split, open_lines, open_head, open_at, seen = here, [], False, 0, 0
            begins = np.flatnonzero(start.slice(lo, hi - lo).to_numpy(zero_copy_only=False))
            texts = line.slice(lo, hi - lo)
            size = hi - lo
            lead = int(begins[0]) if len(begins) else size
            if lead:
                if not open_lines:
                    open_head, open_at = True, seen
                open_lines.extend(texts.slice(0, lead).to_pylist())
            if len(begins):
                if open_lines:
                    yield close(tail=False)
                closed = begins[:-1]
                if len(closed):
                    offsets = pa.array(begins.astype("int32"), pa.int32())
                    lists = pa.ListArray.from_arrays(offsets, texts)
                    counts = np.diff(begins)
                    flags = np.zeros(len(closed), dtype=bool)
                    yield emit(seen + closed, pc.binary_join(lists, "\n"), counts, flags, flags)
                last = int(begins[-1])
                open_lines, open_head, open_at = texts.slice(last).to_pylist(), False, seen + last
            seen += size
    if open_lines:
        yield close(tail=True)
