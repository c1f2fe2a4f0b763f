"""Exact medians and quantiles over tables of any size.

Spark's own exact percentile keeps every distinct value of a group in one task's memory. Beyond ``IN_MEMORY`` rows the quantile is enclosed twice by sketches of
bounded size: the first leaves some 4 in 10,000 of the rows, and a sketch of those, with marks at every thousandth, some 15 in 10,000 of them. Rows below are counted
exactly, and only the distinct values that are left, less than one in a million of the rows, are put in order. Both ways give the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a table up to which Spark's own exact percentile is used.
IN_MEMORY = 2_000_000
#: A sketch's ranks are off by a share of 1 / ACCURACY of its rows at most.
ACCURACY = 10_000
#: Marks of the second sketch.
MARKS = 1000
#: Rows from which a group counts as large.
LARGE = 1_000_000


def quantiles(df: DataFrame, keys: dict[str, Column], value: Column, fractions: list[float], out: str, rows: int) -> DataFrame:
    """(keys, ``out``: an array with a quantile for each of ``fractions``, by linear interpolation); blanks are passed over, and a group
    without a value has null or no row. ``rows`` is the table's size."""
    by = [c.alias(k) for k, c in keys.items()]
    if rows <= IN_MEMORY:
        found = F.percentile(value.cast("double"), F.array(*map(F.lit, fractions))).alias(out)
        return df.groupBy(*by).agg(found) if keys else df.agg(found)
    return _bracketed(df.select(*by, value.cast("double").alias("_x")).where("_x is not null"), list(keys), fractions, out)


def _bracketed(values: DataFrame, keys: list[str], fractions: list[float], out: str) -> DataFrame:
    ends = [min(1.0, max(0.0, f + side * 2 / ACCURACY)) for f in fractions for side in (-1, 1)]
    sketched = values.groupBy(*keys).agg(
        F.count("_x").alias("_n"), F.min("_x").alias("_min"), F.max("_x").alias("_max"), F.percentile_approx("_x", ends, ACCURACY).alias("_ends")
    )
    few = F.col("_n") <= ACCURACY
    parts = [
        F.struct(
            F.lit(i).alias("i"), ((F.col("_n") - 1) * F.lit(f)).alias("at"),
            F.when(few, F.col("_min")).otherwise(F.col("_ends")[2 * i]).alias("lo"), F.when(few, F.col("_max")).otherwise(F.col("_ends")[2 * i + 1]).alias("hi"),
        )
        for i, f in enumerate(fractions)
    ]
    brackets = sketched.select(*keys, F.array(*parts).alias("_parts"), (F.col("_n") >= LARGE).alias("_large"))
    # rows below a bracket count together, those within it make the second sketch, those above are passed over
    by = [*keys, "_large", F.col("p.i").alias("i"), F.col("p.at").alias("at")]
    ends = [F.min("p.lo").alias("lo"), F.max("p.hi").alias("hi")]
    met = _within(values, brackets, keys)
    inner = met.groupBy(*by).agg(*ends, F.count("_in").alias("m"), F.count_if(F.col("_in").isNull()).alias("below"), F.percentile_approx("_in", [k / MARKS for k in range(MARKS + 1)], ACCURACY).alias("marks"))
    place = lambda rank, side: ((rank - F.col("below")) / F.col("m") + side * 2 / ACCURACY) * MARKS
    left, right = F.floor(place(F.floor("at"), -1)).cast("int"), F.ceil(place(F.ceil("at") + 1, 1)).cast("int")
    many = (F.col("m") > MARKS) & F.col("marks").isNotNull()
    narrow = F.struct(
        "i", "at", F.when(many & (left > 0), F.get("marks", left)).otherwise(F.col("lo")).alias("lo"), F.when(many & (right < MARKS), F.get("marks", right)).otherwise(F.col("hi")).alias("hi")
    )
    brackets = inner.groupBy(*keys, "_large").agg(F.collect_list(narrow).alias("_parts"))  # one for each fraction
    counted = _within(values, brackets, keys).groupBy(*keys, F.col("p.i").alias("_i"), F.col("p.at").alias("_at"), F.col("_in").alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    through = F.sum("_n").over(Window.partitionBy(*keys, "_i").orderBy(F.col("_x").asc_nulls_first()))
    ranked = counted.withColumn("_through", through)
    value_at = lambda rank: F.min(F.when((F.col("_through") > rank) & F.col("_x").isNotNull(), F.col("_x")))
    found = ranked.groupBy(*keys, "_i", "_at").agg(value_at(F.floor("_at")).alias("a"), value_at(F.ceil("_at")).alias("b"))
    share = F.col("_at") - F.floor("_at")
    placed = found.select(*keys, F.struct("_i", (F.col("a") + (F.col("b") - F.col("a")) * share).alias("q")).alias("p"))
    return placed.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["q"]).alias(out))


def _within(values: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _large, p, _in) for each value and bracket p of its group that it doesn't lie above; _in is null below the bracket.

    Brackets of large groups, at most one for each ``LARGE`` rows of the table, are sent to where the values lie. Only values of other groups are shuffled, so that no task has all rows of a
    large one to sort.
    """
    if not keys:
        met = values.withColumns({"_parts": brackets.select("_parts").scalar(), "_large": F.lit(True)})
    else:
        same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
        parts = [*(F.col(f"l.{k}").alias(k) for k in keys), "_x", "r._parts", "r._large"]
        large, small = brackets.where("_large"), brackets.where("NOT _large")
        rest = values.alias("l").join(F.broadcast(large.select(*keys)).alias("r"), same, "left_anti").alias("l")
        met = values.alias("l").join(F.broadcast(large).alias("r"), same).select(*parts).union(rest.join(small.alias("r"), same).select(*parts))
    met = met.select(*keys, "_large", "_x", F.explode("_parts").alias("p")).where("_x <= p.hi")
    return met.select(*keys, "_large", "p", F.when(F.col("_x") >= F.col("p.lo"), F.col("_x")).alias("_in"))
