"""Cells as people read them."""

from __future__ import annotations

import datetime as dt

from gatedframe.model import DATE


def format_cell(value: object, kind: str) -> str:
    """A dash for nothing; dates as a day, or to the minute; numbers with grouped thousands and four decimals at most."""
    if value is None:
        return "—"
    if kind == DATE:
        if isinstance(value, (int, float)):
            value = dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=value)
        if not isinstance(value, dt.datetime):
            return value.isoformat()
        return value.strftime("%Y-%m-%d") if value.time() == dt.time() else value.strftime("%Y-%m-%d %H:%M")
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        text = f"{value:,.4f}".rstrip("0").rstrip(".")
        return "0" if text == "-0" else text
    return str(value)
