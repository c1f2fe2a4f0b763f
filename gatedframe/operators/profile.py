"""Column profiles: counts for all, statistics and top categories where the group-size rule lets them out."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatedframe.errors import QueryError
from gatedframe.model import DATE, NUMBER, RID, Dataset, Field
from gatedframe.operators.disclosure import threshold
from gatedframe.operators.quantiles import quantiles

MOST_DISTINCT, MOST_DISTINCT_RATIO, TOP = 50, 0.5, 5


def round_up(value: float | None, places: int) -> float | None:
    """Halves go towards positive infinity."""
    return None if value is None else math.floor(value * 10**places + 0.5) / 10**places


def pick_columns(dataset: Dataset, names: list[str] | None) -> list[Field]:
    """The columns asked for, in the order asked for; all without any."""
    unknown = [n for n in names or [] if dataset.find(n) is None]
    if unknown:
        raise QueryError("unknown_column", f'No column named {", ".join(repr(n) for n in unknown)} in "{dataset.id}".', {"unknown": unknown, "availableColumns": dataset.names})
    return [dataset.find(n) for n in names] if names else list(dataset.fields)


def statistics(dataset: Dataset, fields: list[Field]) -> DataFrame:
    """One row: rows, n<i> filled and d<i> distinct cells, lo<i> and hi<i> of numbers and dates, mean<i>, dev<i> and the exact mid<i> of numbers.

    One aggregation reads all columns. Distinct values and medians come from subqueries of the same plan, a column each, so that no
    row is unfolded once per column and no task keeps all values of a column.
    """
    wanted, parts = [F.count(F.lit(1)).alias("rows")], {}
    for i, f in enumerate(fields):
        wanted.append(F.count(f.column).alias(f"n{i}"))
        parts[f"d{i}"] = dataset.df.select(f.column.alias("v")).distinct().agg(F.count("v")).scalar()
        if f.type in (NUMBER, DATE):
            wanted += [F.min(f.column).alias(f"lo{i}"), F.max(f.column).alias(f"hi{i}")]
        if f.type == NUMBER:
            c = f.column.cast("double")
            wanted += [F.avg(c).alias(f"mean{i}"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"dev{i}")]
            parts[f"mid{i}"] = quantiles(dataset.df, {}, f.column, [0.5], "q", dataset.row_count).select(F.col("q")[0]).scalar()
    return dataset.df.agg(*wanted).withColumns(parts)


def top_categories(dataset: Dataset, field: Field, k: int, limit: int = TOP):
    """(value, n) of the commonest values with k rows or more; equal counts in order of appearance."""
    counted = dataset.number(dataset.df.where(field.raw.isNotNull())).groupBy(field.column.alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min(RID).alias("_first"))
    return counted.where(F.col("n") >= k).orderBy(F.desc("n"), "_first").limit(limit).select("value", "n")


def _categories(dataset: Dataset, field: Field, filled: int, distinct: int, k: int) -> dict:
    """``topCategories``, or ``categoriesWithheld`` with the reason."""
    if field.type in (NUMBER, DATE):
        return {"categoriesWithheld": "Values of this column lie on a scale, so it is summed up by its statistics and has no categories."}
    if not distinct:
        return {"topCategories": []}
    if distinct > MOST_DISTINCT:
        return {"categoriesWithheld": f"With {distinct} different values the column tells rows apart instead of sorting them into kinds."}
    if distinct / filled > MOST_DISTINCT_RATIO:
        return {"categoriesWithheld": "Most filled cells hold a value of their own, and a list of them would point at single rows."}
    found = top_categories(dataset, field, k).collect()
    if not found:
        return {"categoriesWithheld": f"None of the values is shared by {k} rows, which is the least a named category needs."}
    return {"topCategories": [{"value": r.value, "count": r.n} for r in found]}


def profile_dataset(dataset: Dataset, columns: list[str] | None = None, k: int = 1) -> list[dict]:
    k, fields = threshold(k), pick_columns(dataset, columns)
    if not fields:
        return []
    s = statistics(dataset, fields).first()
    out = []
    for i, f in enumerate(fields):
        filled, distinct = s[f"n{i}"], s[f"d{i}"]
        nulls = s["rows"] - filled
        found = {"name": f.name, "type": f.type, "count": s["rows"], "nulls": nulls, "nullRate": round_up(nulls / s["rows"], 3) if s["rows"] else 0, "distinct": distinct, "invalid": f.invalid}
        if f.type in (NUMBER, DATE):
            if filled and filled >= k:
                found |= {"min": s[f"lo{i}"], "max": s[f"hi{i}"]}
                if f.type == NUMBER:
                    found |= {"mean": round_up(s[f"mean{i}"], 4), "medianValue": round_up(s[f"mid{i}"], 4), "stdDev": round_up(s[f"dev{i}"], 4)}
            elif filled:
                found["statisticsWithheld"] = f"The column is filled in {filled} row{'' if filled == 1 else 's'}; from {k} on its statistics would be given."
        out.append(found | _categories(dataset, f, filled, distinct, k))
    return out
