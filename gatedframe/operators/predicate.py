"""The eleven filter operators, joined by AND."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatedframe.errors import QueryError
from gatedframe.functions.coerce import filter_value, number_string
from gatedframe.functions.text import cell_text, utf16
from gatedframe.model import DATE, INFINITY, STRING, Dataset, Field

OPERATORS = ("eq", "ne", "gt", "gte", "lt", "lte", "contains", "starts_with", "in", "is_null", "is_not_null")


def _literal(value: object, field: Field, dataset: Dataset) -> Column:
    if field.type == DATE and isinstance(value, dt.datetime):
        return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast(dataset.df.schema[field.physical].dataType)
    return F.lit(value)


def _units(field: Field, value: object) -> tuple[Column, Column] | None:
    """Both sides as UTF-16 bytes where text must be compared by code units and code points would give another order: only if
    ``value`` holds a letter from U+E000 on."""
    if field.type == STRING and isinstance(value, str) and any(c >= "\ue000" for c in value):
        return utf16(field.raw), utf16(F.lit(value))
    return None


def _read(value: object, field: Field) -> object:
    readable, found = filter_value(value, field.type)
    if not readable:
        raise QueryError("type_mismatch", f'The value {value!r} can\'t be read as {field.type}, the type of "{field.name}".', {"column": field.name, "type": field.type})
    return found


def _compare(op: str, field: Field, value: object, dataset: Dataset) -> Column:
    """Nulls never match. A null value stands behind every other, so that ``ne``, ``lt`` and ``lte`` match all that is filled.

    Comparisons are those of the physical column. NaN and infinities, which count as blanks, are kept out by one comparison more where the first lets them in.
    """
    c = field.raw
    if value is None:
        return _filled(field) if op in ("ne", "lt", "lte") else F.lit(False)
    v = _literal(value, field, dataset)
    if op in ("eq", "ne"):
        met = c == v if op == "eq" else c != v
        return met & field.finite if field.floating and op == "ne" else met
    left, right = _units(field, value) or (c, v)
    met = {"gt": left > right, "gte": left >= right, "lt": left < right, "lte": left <= right}[op]
    return met & (c < INFINITY if op in ("gt", "gte") else c > -INFINITY) if field.floating else met


def _filled(field: Field) -> Column:
    return field.finite if field.floating else field.raw.isNotNull()


def _blank(field: Field) -> Column:
    """A scan's statistics pass over NaN, so that of a floating column the test for blanks stays above the scan."""
    return field.raw.isNull() | F.isnan(field.raw) | (F.abs(field.raw) == INFINITY) if field.floating else field.raw.isNull()


def predicate(dataset: Dataset, spec: dict) -> Column:
    """One filter ``{column, op, value}`` as a boolean expression."""
    field = dataset.find(spec.get("column"))
    if field is None:
        raise QueryError("unknown_column", f'There is no column named "{spec.get("column")}" in "{dataset.id}".', {"availableColumns": dataset.names})
    op = spec.get("op")
    if op not in OPERATORS:
        raise QueryError("invalid_filter", f'"{op}" is not a filter operator.', {"operators": list(OPERATORS)})
    if op in ("is_null", "is_not_null"):
        return _blank(field) if op == "is_null" else _filled(field)
    if op == "in":
        values = spec.get("value")
        if not isinstance(values, list) or not values:
            raise QueryError("invalid_filter", '"in" needs a list of at least one value.', {"column": field.name})
        read = [_read(v, field) for v in values]
        filled = [_literal(v, field, dataset) for v in read if v is not None]
        met = field.raw.isin(*filled) if filled else F.lit(False)
        return met | _blank(field) if None in read else met
    if "value" not in spec:
        raise QueryError("invalid_filter", f'"{op}" needs a value.', {"column": field.name})
    if op in ("contains", "starts_with"):
        if not isinstance(spec["value"], str):
            raise QueryError("invalid_filter", f'"{op}" needs a text value.', {"column": field.name})
        text, part = F.lower(cell_text(field.column, field.type)), F.lower(F.lit(spec["value"]))
        return F.contains(text, part) if op == "contains" else F.startswith(text, part)
    value = _read(spec["value"], field)
    return _compare(op, field, number_string(value) if field.type == STRING and isinstance(value, float) else value, dataset)


def conjunction(dataset: Dataset, filters: list[dict] | None) -> Column | None:
    """All filters together; None without any, so that no filter reaches the plan."""
    parts = [predicate(dataset, f) for f in filters or []]
    return reduce(lambda a, b: a & b, parts) if parts else None
