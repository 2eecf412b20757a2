"""The row operators on a stream of whole records: they keep no state, so they run on ``readStream`` unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame

from emberlog.operators.formats import parse_records
from emberlog.operators.groups import with_pattern


def parse_stream(records: DataFrame, source_type: str = "auto") -> DataFrame:
    """Parsed records with ``is_error`` and ``pattern`` for a streaming frame with a ``raw`` column."""
    return with_pattern(parse_records(records, source_type))
