"""Words are maximal runs of bytes other than space, tab, LF, VT, FF and CR."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: bytes.translate table that lower-cases A-Z alone. Applied to UTF-8 it leaves other letters as they are.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def word_array(text: Column) -> Column:
    """The words of a text, in order; none for a null or blank one."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def word_count(text: Column) -> Column:
    return F.size(word_array(text)).cast("long")


def utf8(values: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The bytes of a string column; a null counts as the empty text."""
    return [b"" if v is None else v for v in values.cast(pa.binary()).to_pylist()]


def pieces(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to ``rows`` rows at most, so that Python objects of few texts live at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
