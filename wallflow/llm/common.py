"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A side is broadcast only when it was counted and found below these bounds.
BROADCAST_ROWS = 200_000

# Rows handed to Python code at once inside a task.
SLICE_ROWS = 256


def text_of(name: str = "text") -> Column:
    """The text, a null one read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table of a few narrow columns may be broadcast; it is counted in full."""
    return df.agg(F.count(F.lit(1)).alias("n")).first()["n"] <= rows


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The record batches of a task, cut to at most ``rows`` rows each."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
