"""Help for the optimizer."""

from __future__ import annotations

import weakref
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def settled(col: Column) -> Column:
    """The same value, but the optimizer leaves the projection that computes it in its place.

    The operators are long chains of projections in which most columns are read more than once. A filter pushed below such
    a chain, or a constraint inferred through it, carries the expressions of the whole chain, multiplied at every step.
    The partition id marks a projection as one not to look through; it does not influence the value.
    """
    return F.when(F.spark_partition_id() >= 0, col)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed, and written into the plan, once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class Steps(list):
    """Steps written down to be replayed on any frame."""


def add(target: DataFrame | Steps, columns: str | dict[str, Column], col: Column | None = None) -> DataFrame | Steps:
    """Add or replace one or several columns as one settled step; all of them read the columns before the step."""
    named = {columns: col} if isinstance(columns, str) else columns
    named = {name: settled(value) for name, value in named.items()}
    if isinstance(target, Steps):
        target.append(named)
        return target
    return target.withColumns(named)


#: Step lists kept for a session; the oldest goes first.
KEPT_STEPS = 64
_written: weakref.WeakKeyDictionary[SparkSession, dict[tuple, Steps]] = weakref.WeakKeyDictionary()


def replay(df: DataFrame, write: Callable[..., None], *args) -> DataFrame:
    """Apply the steps that ``write(steps, *args)`` writes down.

    Building a few thousand column expressions takes seconds of talk with the JVM, so they are kept for the session.
    """
    kept, key = _written.setdefault(df.sparkSession, {}), (write, args)
    if key not in kept:
        steps = Steps()
        write(steps, *args)
        kept[key] = steps
        if len(kept) > KEPT_STEPS:
            kept.pop(next(iter(kept)))
    for step in kept[key]:
        df = df.withColumns(step)
    return df
