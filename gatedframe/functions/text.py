"""Text and number expressions that follow the ECMAScript rules the data was defined by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatedframe.model import BOOLEAN, DATE, NUMBER

#: Fixed value: the white space that trimming removes.
SPACES = "\t\n\x0b\f\r\x20\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def js_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def utf16(c: Column) -> Column:
    """Text as bytes whose order is that of UTF-16 code units."""
    return F.encode(c, "UTF-16BE")


def half_up(c: Column, places: int) -> Column:
    """Rounded with halves towards positive infinity."""
    scale = float(10**places)
    return F.floor(c.cast("double") * scale + 0.5) / scale


def number_text(c: Column) -> Column:
    """A number as ECMAScript prints it: no trailing zeros, exponents only below 1e-6 and from 1e21.

    Numbers between 1e15 and 1e21, and long fractions, are printed by way of a decimal(38, 18).
    """
    d = c.cast("double")
    size = F.abs(d)
    whole = (d == F.floor(d)) & (size < 1e15)
    plain = F.regexp_replace(F.regexp_replace(d.try_cast("decimal(38,18)").cast("string"), r"0+\z", ""), r"\.\z", "")
    mantissa = F.regexp_extract(d.cast("string"), r"^(-?[0-9.]+?)(?:\.0)?E", 1)
    power = F.regexp_extract(d.cast("string"), r"E(-?[0-9]+)\z", 1)
    exponent = F.concat(mantissa, F.lit("e"), F.when(power.startswith("-"), F.lit("")).otherwise(F.lit("+")), power)
    return F.when(whole, d.cast("bigint").cast("string")).when((size >= 1e21) | (size < 1e-6), exponent).otherwise(plain)


def cell_text(c: Column, kind: str) -> Column:
    """The text that substring predicates look into: numbers and booleans as printed, dates as epoch milliseconds."""
    if kind == NUMBER:
        return number_text(c)
    if kind == DATE:
        return F.unix_millis(c.cast("timestamp")).cast("string")
    return c.cast("string") if kind == BOOLEAN else c
