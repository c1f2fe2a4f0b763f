"""Aggregate queries over one dataset: filter, group, aggregate, suppress, order, limit."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatedframe.errors import QueryError
from gatedframe.functions.text import utf16
from gatedframe.model import DATE, NUMBER, RID, STRING, Dataset, Field
from gatedframe.operators.disclosure import identifies, suppress, threshold
from gatedframe.operators.predicate import conjunction
from gatedframe.operators.quantiles import IN_MEMORY, quantiles

DEFAULT_LIMIT, MOST_ROWS = 20, 50
NUMERIC_ONLY = ("sum", "avg", "median")
ORDERED_ONLY = ("min", "max")
#: Aggregates that pass over blank cells.
SKIP_BLANKS = NUMERIC_ONLY + ORDERED_ONLY
AGGREGATES = ("count", "count_distinct", *NUMERIC_ONLY, *ORDERED_ONLY)


@dataclass
class QueryResult:
    columns: list[dict]
    rows: list[list]
    matched_rows: int
    matched_rows_identifying: bool
    total_groups: int
    truncated: bool
    blanks_skipped: list[str]


def _aggregation(dataset: Dataset, spec: dict) -> Field | None:
    op, name = spec.get("op"), spec.get("column")
    if op not in AGGREGATES:
        raise QueryError("invalid_aggregation", f'"{op}" is not an aggregate.', {"aggregates": list(AGGREGATES)})
    if name is None:
        if op != "count":
            raise QueryError("invalid_aggregation", f'"{op}" needs a column.')
        return None
    field = dataset.find(name)
    if field is None:
        raise QueryError("unknown_column", f'There is no column named "{name}" in "{dataset.id}".', {"availableColumns": dataset.names})
    allowed = (NUMBER,) if op in NUMERIC_ONLY else (NUMBER, DATE) if op in ORDERED_ONLY else None
    if allowed and field.type not in allowed:
        raise QueryError("type_mismatch", f'"{op}" needs a column of type {" or ".join(allowed)}; "{name}" is {field.type}.', {"column": name, "type": field.type})
    return field


def _limit(spec: dict) -> int:
    limit = spec.get("limit")
    if limit is None:
        return DEFAULT_LIMIT
    if isinstance(limit, bool) or not isinstance(limit, (int, float)) or not math.isfinite(limit) or limit != int(limit) or limit < 1:
        raise QueryError("invalid_limit", "The limit must be a whole number of 1 or more.", {"limit": limit})
    return min(int(limit), MOST_ROWS)


def _expression(op: str, field: Field | None) -> Column:
    if op == "count":
        return F.count(F.lit(1))
    c = field.column
    return {"count_distinct": F.count_distinct, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "median": F.median}[op](c)


class Query:
    """A validated query. ``frame`` is the lazy result; ``run`` also gives the counts that go with it.

    Validation follows a fixed order: aggregates, grouping, limit, filters, and ordering last.
    """

    def __init__(self, dataset: Dataset, spec: dict):
        self.dataset, self.k = dataset, threshold(spec.get("minGroupSize"))
        asked = spec.get("aggregate") or []
        if not asked:
            raise QueryError("no_aggregation", "A query needs at least one aggregate; rows themselves are not returned.")
        self.aggregates = [(a["op"] if "op" in a else None, _aggregation(dataset, a), a.get("as")) for a in asked]
        self.keys: list[Field] = []
        for name in spec.get("groupBy") or []:
            if (found := dataset.find(name)) is None:
                raise QueryError("unknown_column", f'There is no column named "{name}" in "{dataset.id}".', {"availableColumns": dataset.names})
            self.keys.append(found)
        self.limit = _limit(spec)
        where = conjunction(dataset, spec.get("where"))
        self.filtered = dataset.df if where is None else dataset.df.where(where)
        self.narrowed = where is not None
        self.columns = [{"name": f.name, "type": f.type} for f in self.keys]
        for op, field, name in self.aggregates:
            kind = DATE if op in ORDERED_ONLY and field.type == DATE else NUMBER
            self.columns.append({"name": name or (op if field is None or op == "count" else f"{op}_of_{field.name}"), "type": kind})
        self.internal = [f"_k{i}" for i in range(len(self.keys))] + [f"_a{i}" for i in range(len(self.aggregates))]
        names = [c["name"] for c in self.columns]
        self.order: list[Column] = []
        for key in spec.get("orderBy") or []:
            if key.get("column") not in names:
                raise QueryError("unknown_column", f'Results can\'t be ordered by "{key.get("column")}"; it is not one of their columns.', {"availableColumns": names})
            at = names.index(key["column"])
            c = F.col(self.internal[at])
            c = utf16(c) if self.columns[at]["type"] == STRING else c
            self.order.append(c.desc_nulls_last() if key.get("direction") == "desc" else c.asc_nulls_last())
        self._matched: int | None = None

    @property
    def matched(self) -> int:
        """Rows that the filter leaves; counted by a job of its own unless there is no filter or ``run`` has summed up its groups."""
        if self._matched is None:
            self._matched = self.filtered.count() if self.narrowed else self.dataset.row_count
        return self._matched

    def _joined(self, grouped: DataFrame, keys: dict[str, Column], found: DataFrame, name: str) -> DataFrame:
        """``grouped`` with the column ``name`` of ``found``, which has the same groups."""
        if not keys:
            return grouped.withColumn(name, found.select(name).scalar())
        found = found.select(*(F.col(k).alias(f"_r{k}") for k in keys), name)
        return grouped.join(found, [F.col(k).eqNullSafe(F.col(f"_r{k}")) for k in keys], "left").drop(*(f"_r{k}" for k in keys))

    def grouped(self, with_filled: bool = True) -> DataFrame:
        """All groups, with internal names, their size, first row, and, if asked for, the filled cells of each aggregate.

        What would widen the one aggregation over the table is worked out beside it: medians of large tables, and distinct counts next to a median or to one another, for which Spark would
        take every row apart by each distinct value.
        """
        numbered = self.dataset.number(self.filtered)
        ops = [op for op, _, _ in self.aggregates]
        blanks = [F.count(f.column).alias(f"_f{i}") for i, (op, f, _) in enumerate(self.aggregates) if with_filled and op in SKIP_BLANKS]
        large = "median" in ops and self.dataset.row_count > IN_MEMORY
        counted = {f.physical for op, f, _ in self.aggregates if op == "count_distinct"}
        beside = lambda op: (large and op == "median") or (op == "count_distinct" and ("median" in ops or len(counted) > 1))
        values = [_expression(op, f).alias(f"_a{i}") for i, (op, f, _) in enumerate(self.aggregates) if not beside(op)]
        sized = [F.count(F.lit(1)).alias("_n"), F.min(RID).alias("_first"), *values, *blanks]
        keys = {f"_k{i}": f.column for i, f in enumerate(self.keys)}
        by = [c.alias(k) for k, c in keys.items()]
        grouped = numbered.groupBy(*by).agg(*sized) if keys else numbered.agg(*sized)
        for i, (op, f, _) in enumerate(self.aggregates):
            if beside(op) and op == "median":
                found = quantiles(self.filtered, keys, f.column, [0.5], "_q", self.dataset.row_count)
                grouped = self._joined(grouped, keys, found.withColumn(f"_a{i}", F.col("_q")[0]), f"_a{i}")
            elif beside(op):
                each = self.filtered.select(*by, f.column.alias("_v")).distinct()
                found = each.groupBy(*keys).agg(F.count("_v").alias(f"_a{i}")) if keys else each.agg(F.count("_v").alias(f"_a{i}"))
                grouped = self._joined(grouped, keys, found, f"_a{i}")
        return grouped

    def shown(self) -> DataFrame:
        """Groups that may be shown, lazily: the rows that match are the sum of the groups' sizes, and the table's rows are counted from what its files say of themselves.

        The sum is a subquery over the same aggregation. It asks for a hash of all columns besides, so that nothing of the aggregation is pruned and its exchange is used again
        instead of scanning the table twice.
        """
        grouped = self.grouped(with_filled=False)
        if self.k <= 1:
            return grouped
        matching: Column | int = F.col("_n")
        if self.keys:
            sums = grouped.agg(F.struct(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.bit_xor(F.xxhash64(*grouped.columns)).alias("all")).alias("s"))
            matching = sums.scalar()["n"]
        total = self.dataset.loaded_rows if self.dataset.loaded_rows is not None else self.dataset.df.agg(F.count(F.lit(1))).scalar()
        return suppress(grouped, "_n", matching, total, self.k)

    def frame(self, limited: bool = True) -> DataFrame:
        """The result as a DataFrame; repeated names get their position behind them."""
        kept = self.shown().orderBy(*self.order, F.col("_first").asc_nulls_last())
        kept = kept.limit(self.limit) if limited else kept
        names: list[str] = []
        for c in self.columns:
            names.append(c["name"] if c["name"] not in names else f"{c['name']}_{len(names)}")
        return kept.select(*(F.col(i).alias(n) for i, n in zip(self.internal, names)))

    def run(self) -> QueryResult:
        """One pass over the table: the groups are kept while their sizes are summed, the first are taken, and, where there are more, all are counted."""
        grouped = self.grouped().persist()
        try:
            if self._matched is None:
                self._matched = (grouped.agg(F.sum("_n")).first()[0] or 0) if self.narrowed else self.dataset.row_count
            kept = suppress(grouped, "_n", self.matched, self.dataset.row_count, self.k)
            top = kept.orderBy(*self.order, F.col("_first").asc_nulls_last()).limit(self.limit + 1).collect()  # 51 rows at most
            skipping = [(i, f) for i, (op, f, _) in enumerate(self.aggregates) if op in SKIP_BLANKS]
            if len(top) > self.limit:
                counted = kept.agg(F.count(F.lit(1)).alias("n"), *(F.bool_or(F.col(f"_f{i}") < F.col("_n")).alias(f"b{i}") for i, _ in skipping)).first()
                total, blank = counted["n"], {f.name for i, f in skipping if counted[f"b{i}"]}
            else:
                total, blank = len(top), {f.name for i, f in skipping if any(r[f"_f{i}"] < r["_n"] for r in top)}
        finally:
            grouped.unpersist()
        rows = [[r[c] for c in self.internal] for r in top[: self.limit]]
        hidden = identifies(self.matched, self.matched, self.dataset.row_count, self.k)
        return QueryResult(self.columns, rows, self.matched, hidden, total, total > self.limit, sorted(blank))


def run_query(dataset: Dataset, spec: dict) -> QueryResult:
    return Query(dataset, spec).run()


def query_frame(dataset: Dataset, where: Sequence[dict] = (), group_by: Sequence[str] = (), aggregate: Sequence[dict] = (), order_by: Sequence[dict] = (), k: int = 1, limit: int | None = None) -> DataFrame:
    """A query as a lazy DataFrame; without a limit all groups are returned."""
    spec = {"where": list(where), "groupBy": list(group_by), "aggregate": list(aggregate), "orderBy": list(order_by), "minGroupSize": k, "limit": limit}
    return Query(dataset, spec).frame(limited=limit is not None)
