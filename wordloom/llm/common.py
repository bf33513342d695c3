"""Small helpers shared by the corpus operators: shared folders, written tables, words."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import shared_path as fresh_path
from ..tables import written

__all__ = ["SEPARATORS", "WORD", "bounded_rows", "fresh_path", "map_rows", "slices", "window_codes", "word_count", "written"]

#: What separates words: the blank and the ASCII controls from tab to carriage return.
#: ``bytes.split()`` without an argument cuts at exactly these.
SEPARATORS = " \t\n\v\f\r"
WORD = "[^\\x20\\x09-\\x0D]+"
#: Rows of a slice that a Python task holds as Python objects at one time, and their bytes (or one row).
SLICE, SLICE_BYTES = 256, 16 << 20


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Collect a table whose size the caller states a bound for; more rows are an error, never a cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows")
    return rows


def word_count(text: Column) -> Column:
    """Number of words; null counts as no text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces small enough to hold as Python objects, however long the texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield from _halves(batch.slice(at, SLICE))


def _halves(piece: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    if piece.num_rows > 1 and piece.nbytes > SLICE_BYTES:
        half = piece.num_rows // 2
        yield from _halves(piece.slice(0, half))
        yield from _halves(piece.slice(half))
    else:
        yield piece


def map_rows(df: DataFrame, make: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """Run ``make(*column_lists)`` over slices of the rows and gather the tuples it yields as rows."""
    fields = df.sparkSession.createDataFrame([], schema).schema
    names = fields.names
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            rows = list(make(*(c.to_pylist() for c in piece.columns)))
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, arrow.field(n).type) for c, n in zip(columns, names, strict=True)], schema=arrow)

    return df.mapInArrow(run, fields)


_FACTOR = 0x9E3779B97F4A7C15


def window_codes(values: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit code for each ``width`` neighbouring values (uint64): equal windows have equal codes."""
    if len(values) < width:
        return np.zeros(0, np.uint64)

    def joined(a: np.ndarray, wide: int, b: np.ndarray, step: int) -> np.ndarray:
        """Windows made of one of ``a`` and the one of ``b`` right after it."""
        n = len(b) - wide
        return a[:n] * np.uint64(pow(_FACTOR, step, 1 << 64)) + b[wide:]

    done, have, power, step, rest = None, 0, values, 1, width
    while rest:
        if rest & 1:
            done, have = (power, step) if done is None else (joined(done, have, power, step), have + step)
        rest >>= 1
        if rest:
            power, step = joined(power, step, power, step), step * 2
    return done
