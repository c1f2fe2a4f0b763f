"""Reading text cells as the four logical types, as expressions; and the same for single filter values."""

from __future__ import annotations

import datetime as dt
import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatedframe.functions.text import SPACES, js_trim
from gatedframe.model import BOOLEAN, DATE, INFINITY, NUMBER, STRING

#: Least share of a column's filled cells that must read as a type.
CONFIDENCE = 0.95

#: Spellings of nothing, true and false; forms of numbers and of ISO dates.
NULLISH = ["", "null", "na", "n/a", "nan", "none", "nil", "#n/a"]
TRUE, FALSE = ["true", "yes"], ["false", "no"]
CURRENCIES = ["$", "£", "€", "¥", "₹"]
SYMBOL = r"^[-+]?\s*[$£€¥₹]\s*"
NUMERIC = r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?"
ISO = r"(\d{4})[-/](0[1-9]|1[0-2])[-/](0[1-9]|[12]\d|3[01])(?:[T ]([01]\d|2[0-3]):([0-5]\d)(?::([0-5]\d)(\.\d+)?)?(?:(Z)|([+-])(\d{2}):?(\d{2}))?)?"


def _nullish(text: Column) -> Column:
    return text.isNull() | F.lower(text).isin(NULLISH)


def is_nullish(raw: Column) -> Column:
    return _nullish(js_trim(raw))


def _word(text: Column) -> Column:
    word = F.lower(text)
    return F.when(word.isin(TRUE), F.lit(True)).when(word.isin(FALSE), F.lit(False))


def as_boolean(raw: Column) -> Column:
    return _word(js_trim(raw))


def _negated(text: Column) -> Column:
    return text.startswith("(") & text.endswith(")") & (F.length(text) > 1) & ~text.rlike(r"[\n\r]")


def _body(text: Column) -> Column:
    return F.when(_negated(text), js_trim(F.substring(text, F.lit(2), F.length(text) - 2))).otherwise(text)


def _bare(body: Column) -> Column:
    """Without a currency sign, spaces beside it, a plus before it, and commas."""
    signed = body.startswith("-") | body.startswith("+")
    rest = F.when(signed, F.ltrim(F.substring(body, F.lit(2), F.length(body)), F.lit(SPACES))).otherwise(body)
    amount = F.concat(F.when(body.startswith("-"), F.lit("-")).otherwise(F.lit("")), F.ltrim(F.substring(rest, F.lit(2), F.length(rest)), F.lit(SPACES)))
    return F.replace(F.when(F.substring(rest, 1, 1).isin(CURRENCIES), amount).otherwise(body), F.lit(","), F.lit(""))


def _amount(bare: Column, text: Column) -> Column:
    value = F.when(bare.rlike(f"^{NUMERIC}\\z"), bare.try_cast("double"))
    return F.when(F.abs(value) < INFINITY, F.when(_negated(text), -value).otherwise(value))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it. Columns of a table do better with projections (``coerce_columns``)."""
    return F.get(F.transform(F.array(value), lambda v: f(v)), F.lit(0))


def as_number(raw: Column) -> Column:
    """Currency signs and thousands separators are dropped, parentheses negate, and percent signs are refused."""
    return _let(js_trim(raw), lambda text: _let(_let(_body(text), _bare), lambda bare: _amount(bare, text)))


def as_date(raw: Column) -> Column:
    """ISO dates and times; day 29 to 31 of a shorter month runs on into the next, and fractions are cut to milliseconds.

    One pattern decides whether a cell is a date. Its parts then stand at fixed places, but for the fraction and the offset, which is sought from the end.
    """
    return _let(js_trim(raw), _moment)


def _moment(text: Column) -> Column:
    at = lambda start, n: F.substring(text, start, n)
    number = lambda c: c.try_cast("int")
    timed = F.length(text) > 10
    seconds = F.when(at(17, 1) == ":", number(at(18, 2))).otherwise(F.lit(0))
    millis = F.when(at(20, 1) == ".", number(F.rpad(F.regexp_extract(text, r"\.(\d{1,3})", 1), 3, "0"))).otherwise(F.lit(0))
    of_day = F.when(timed, number(at(12, 2)) * 3_600_000 + number(at(15, 2)) * 60_000 + seconds * 1000 + millis).otherwise(F.lit(0))
    colon = at(-6, 1).isin("+", "-")
    zoned = timed & (colon | at(-5, 1).isin("+", "-"))
    minutes = number(F.when(colon, at(-5, 2)).otherwise(at(-4, 2))) * 60 + number(at(-2, 2))
    west = F.when(colon, at(-6, 1)).otherwise(at(-5, 1)) == "-"
    offset = F.when(zoned, minutes * F.when(west, F.lit(-60_000)).otherwise(F.lit(60_000))).otherwise(F.lit(0))
    first = F.make_date(number(at(1, 4)), number(at(6, 2)), F.lit(1))
    days = F.unix_date(first).cast("long") + number(at(9, 2)) - 1
    return F.when(text.rlike(f"^{ISO}\\z"), F.timestamp_millis(days * 86_400_000 + of_day - offset))


def coerce(raw: Column, kind: str) -> Column:
    """The cell as ``kind``, null where it is nullish or can't be read; text is kept as it stands."""
    value = {STRING: lambda c: c, NUMBER: as_number, BOOLEAN: as_boolean, DATE: as_date}[kind](raw)
    return F.when(~is_nullish(raw), value)


def _prepared(df: DataFrame, columns: list[str], numbers: list[str]) -> DataFrame:
    """``df`` with _t_<column>, the trimmed text, and for ``numbers`` _b_<column>, the amount without signs and separators.

    What several expressions name is worked out in a projection of its own, so that each cell is trimmed and stripped once.
    """
    df = df.withColumns({f"_t_{c}": js_trim(F.col(c)) for c in columns})
    if numbers:
        df = df.withColumns({f"_b_{c}": _body(F.col(f"_t_{c}")) for c in numbers})
        df = df.withColumns({f"_b_{c}": _bare(F.col(f"_b_{c}")) for c in numbers})
    return df


def coerce_columns(df: DataFrame, kinds: dict[str, str], invalid: str = "") -> DataFrame:
    """``df`` with its text columns ``kinds`` read as ``coerce`` reads them; and <invalid><column>, whether a filled cell could not be read, if
    ``invalid`` is given."""
    numbers = [c for c, k in kinds.items() if k == NUMBER]
    ready = _prepared(df, list(kinds), numbers)

    def read(c: str, kind: str) -> Column:
        text = F.col(f"_t_{c}")
        value = {STRING: lambda: F.col(c), NUMBER: lambda: _amount(F.col(f"_b_{c}"), text), BOOLEAN: lambda: _word(text), DATE: lambda: _moment(text)}[kind]()
        return F.when(~_nullish(text), value)

    typed = ready.withColumns({c: read(c, k) for c, k in kinds.items()})
    if invalid:
        typed = typed.withColumns({f"{invalid}{c}": ~_nullish(F.col(f"_t_{c}")) & F.col(c).isNull() for c in kinds})
    return typed.drop(*(f"_t_{c}" for c in kinds), *(f"_b_{c}" for c in numbers))


#: Where ``type_counts`` has the cells that read as a type.
READS = {BOOLEAN: 1, DATE: 2, NUMBER: 3}


def _reads_as(df: DataFrame) -> DataFrame:
    """``df`` with _k, what the text cell _c reads as: 0 for nothing, 1 to 3 as in ``READS``, 4 for other text. No cell reads as two types.

    Letters and places that every number or date has are looked at before a pattern is tried.
    """
    text, amount = F.col("_t"), F.col("_b")
    df = df.withColumn("_t", js_trim(F.col("_c")))
    df = df.withColumn("_b", F.when(F.substring(text, 1, 1).isin(*"+-(.0123456789", *CURRENCIES), _body(text))).withColumn("_b", _bare(amount))
    dated = F.substring(text, 5, 1).isin("-", "/") & _moment(text).isNotNull()
    kind = F.when(_nullish(text), 0).when(_word(text).isNotNull(), READS[BOOLEAN]).when(dated, READS[DATE]).when(amount.isNotNull() & _amount(amount, text).isNotNull(), READS[NUMBER])
    return df.withColumn("_k", kind.otherwise(4))


def type_counts(df: DataFrame, columns: list[str], *by: str) -> DataFrame:
    """For each of ``by``, of the nth column the filled cells (<n>_0) and those that read as boolean, date and number (<n>_1 to <n>_3).

    Cells are told apart as rows of one column, since the code for all columns side by side grows beyond what the JVM compiles.
    """
    cells = _reads_as(df.select(*by, F.posexplode(F.array(*columns)).alias("_i", "_c")))
    counted = cells.groupBy(*by, "_i", "_k").agg(F.count(F.lit(1)).alias("_n"))
    of = lambda i, met: F.coalesce(F.sum(F.when((F.col("_i") == i) & met, F.col("_n"))), F.lit(0))
    return counted.groupBy(*by).agg(*(of(i, F.col("_k") == j if j else F.col("_k") > 0).alias(f"{i}_{j}") for i in range(len(columns)) for j in range(4)))


def infer_types(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """The type of each text column."""
    seen = type_counts(df, columns).first()
    return {c: choose_type(*(seen[f"{i}_{j}"] for j in range(4))) for i, c in enumerate(columns)}


def choose_type(filled: int, booleans: int, dates: int, numbers: int) -> str:
    for count, kind in ((booleans, BOOLEAN), (dates, DATE), (numbers, NUMBER)):
        if filled and count / filled >= CONFIDENCE:
            return kind
    return STRING


def trim(text: str) -> str:
    return text.strip(SPACES)


def number_value(text: str) -> float | None:
    text = trim(text)
    negated = re.fullmatch(r"\(.*\)", text) is not None
    if negated:
        text = trim(text[1:-1])
    text = re.sub(SYMBOL, lambda m: "-" if "-" in m[0] else "", text).replace(",", "")
    if not re.fullmatch(NUMERIC, text, re.ASCII) or not math.isfinite(float(text)):
        return None
    return -float(text) if negated else float(text)


def date_value(text: str) -> dt.datetime | None:
    found = re.fullmatch(ISO, trim(text), re.ASCII)
    if not found:
        return None
    year, month, day, hour, minute, second, fraction, _, sign, off_hour, off_minute = found.groups()
    if int(year) < 1:
        return None
    at = dt.datetime(int(year), int(month), 1) + dt.timedelta(days=int(day) - 1, hours=int(hour or 0), minutes=int(minute or 0), seconds=int(second or 0))
    at += dt.timedelta(milliseconds=int((fraction or ".0")[1:4].ljust(3, "0")))
    offset = dt.timedelta(hours=int(off_hour or 0), minutes=int(off_minute or 0))
    return at + offset if sign == "-" else at - offset


def filter_value(value: object, kind: str) -> tuple[bool, object]:
    """(readable, value as ``kind``). Null passes for any type; dates come as naive UTC datetimes."""
    if value is None:
        return True, None
    number = isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value)
    if kind == NUMBER:
        found = value if number else number_value(value) if isinstance(value, str) else None
    elif kind == BOOLEAN:
        word = trim(value).lower() if isinstance(value, str) else None
        found = value if isinstance(value, bool) else True if word in TRUE else False if word in FALSE else None
    elif kind == DATE:
        found = dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=value) if number else date_value(value) if isinstance(value, str) else None
    else:
        found = value if isinstance(value, str) else ("true" if value else "false") if isinstance(value, bool) else number_string(value) if number else None
    return found is not None, found


def number_string(value: float) -> str:
    """A number as ECMAScript prints it."""
    if float(value).is_integer() and abs(value) < 1e21:
        return str(int(value))
    text = repr(float(value))
    mantissa, _, power = text.partition("e")
    if power and 1e-6 <= abs(value) < 1e21:
        return f"{value:.20f}".rstrip("0")
    return f"{mantissa.removesuffix('.0')}e{int(power):+d}" if power else text
