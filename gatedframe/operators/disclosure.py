"""The minimum-group-size rule. This is the one place that states it.

With N rows in the dataset and M matching the filter, a result over n rows is withheld unless it is over the whole
dataset, if it describes fewer than k rows, or if taking it from the matching rows or from the whole would leave
between one and k - 1 rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def threshold(k: int | float | None) -> int:
    return max(1, int(k if k is not None else 1))


def identifies(n: int, matching: int, total: int, k: int) -> bool:
    if k <= 1 or n == total:
        return False
    return n < k or 0 < matching - n < k or 0 < total - n < k


def releasable(n: Column, matching: Column | int, total: Column | int, k: int) -> Column:
    """The same rule for a column of group sizes: true where the group may be shown."""
    matching, total = (F.lit(x) if isinstance(x, int) else x for x in (matching, total))
    outside, left = matching - n, total - n
    hidden = (n < k) | ((outside > 0) & (outside < k)) | ((left > 0) & (left < k))
    return (n == total) | ~hidden


def suppress(grouped: DataFrame, size_col: str, matching: Column | int, total: Column | int, k: int) -> DataFrame:
    """Groups that may be shown; the two counts are numbers or scalar subqueries. With k = 1 the rule is off and no filter reaches the plan."""
    return grouped if k <= 1 else grouped.where(releasable(F.col(size_col), matching, total, k))
