"""Logical types, and a dataset as a DataFrame with positional columns."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRING, NUMBER, BOOLEAN, DATE = "string", "number", "boolean", "date"
ID_LENGTH = 40
#: Order of appearance in the source.
RID = "_rid"


INFINITY = float("inf")


@dataclass(frozen=True)
class Field:
    """A column: its name as the source gives it, its logical type, and the physical column that holds it.

    ``floating``: the column may hold NaN and infinities, which count as blanks.
    """

    name: str
    type: str
    physical: str
    invalid: int = 0
    floating: bool = False

    @property
    def raw(self) -> Column:
        """The physical column, which filters compare so that they reach the scan."""
        return F.col(self.physical)

    @property
    def finite(self) -> Column:
        """True where a floating column holds a number; two comparisons that a scan understands."""
        return (self.raw > -INFINITY) & (self.raw < INFINITY)

    @property
    def column(self) -> Column:
        """The value, null where it counts as blank."""
        return F.when(self.finite, self.raw) if self.floating else self.raw


@dataclass
class Dataset:
    """``df`` has one column per field, named by position, so that any source names can be held.

    ``number`` adds ``_rid``, the order of appearance, to ``df`` or to what a filter leaves of it; it is called only where an order is wanted,
    and above the filter, so that it never stands between a filter and the scan. Rows are counted when their number is first asked for. ``release`` gives up what was kept for the dataset.
    """

    id: str
    name: str
    df: DataFrame
    fields: list[Field]
    loaded_rows: int | None = None
    file_rows: int | None = None
    source_bytes: int = 0
    warnings: list[str] = field(default_factory=list)
    loaded_at: float = field(default_factory=time.time)
    number: Callable[[DataFrame], DataFrame] = lambda df: df
    release: Callable[[], None] = lambda: None

    @property
    def row_count(self) -> int:
        if self.loaded_rows is None:
            self.loaded_rows = self.df.count()
        return self.loaded_rows

    @property
    def source_row_count(self) -> int:
        return self.row_count if self.file_rows is None else self.file_rows

    def find(self, name: str) -> Field | None:
        """The first column of exactly this name."""
        return next((f for f in self.fields if f.name == name), None)

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]


def to_dataset_id(name: str) -> str:
    stem = re.sub(r"\.[^.]+$", "", name).lower()
    return re.sub(r"[^a-z0-9]+", "_", stem).strip("_")[:ID_LENGTH] or "dataset"


def unique_dataset_id(base: str, taken: Iterable[str]) -> str:
    used, n, found = set(taken), 1, base
    while found in used:
        n += 1
        found = f"{base}_{n}"
    return found


def logical_type(kind: T.DataType) -> str | None:
    """The logical type of a Spark type, or None for one that is left out."""
    if isinstance(kind, T.NumericType):
        return NUMBER
    if isinstance(kind, T.BooleanType):
        return BOOLEAN
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATE
    return STRING if isinstance(kind, T.StringType) else None
