"""Queries over the given tables, one or more for each operator, with the SQL that they must agree with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatedframe.functions import coerce
from gatedframe.functions.text import half_up
from gatedframe.model import BOOLEAN, DATE, NUMBER, Dataset
from gatedframe.operators import anomalies, profile
from gatedframe.plans.query import query_frame, run_query
from gatedframe.shared import shared_dir
from gatedframe.sources.delimited import load_delimited_table
from gatedframe.sources.parquet import from_frame, spread
from gatedframe.workspace import Workspace

Found = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Found] = {}
ORACLE: dict[str, str] = {}

K1 = "n = total OR NOT (n < {k} OR (m - n > 0 AND m - n < {k}) OR (total - n > 0 AND total - n < {k}))"


def _table(spark: SparkSession, sf_dir: str, table: str, change: Callable[[DataFrame], DataFrame] = lambda df: df):
    return from_frame(change(spark.read.parquet(f"{sf_dir}/{table}.parquet")), table)


def _rounded(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return df.withColumns({n: half_up(F.col(n), 2) for n in names}) if names else df


def _r(expression: str, name: str) -> str:
    return f"floor(({expression}) * 100 + 0.5) / 100 AS {name}"


def _add(name: str, table: str, sql: str, rounded: tuple[str, ...] = (), change: Callable[[DataFrame], DataFrame] = lambda df: df, **spec) -> None:
    def query(spark: SparkSession, sf_dir: str, **other) -> DataFrame:
        """``other`` takes the place of parts of the query, such as ``k=1`` for no disclosure rule."""
        return _rounded(query_frame(_table(spark, sf_dir, table, change), **(spec | other)), rounded)

    QUERIES[name], ORACLE[name] = query, sql


COUNT = [{"op": "count", "as": "n"}]


def _filter(name: str, table: str, where: list[dict], condition: str, group_by: tuple[str, ...] = (), change: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    keys = "".join(f"{g}, " for g in group_by)
    by = f" GROUP BY {', '.join(group_by)}" if group_by else ""
    _add(name, table, f"SELECT {keys}count(*) AS n FROM {table} WHERE {condition}{by}", change=change, where=where, group_by=group_by, aggregate=COUNT)


def _f(column: str, op: str, *value) -> dict:
    return {"column": column, "op": op} | ({"value": value[0]} if value else {})


_filter("filter_eq", "orders", [_f("o_orderstatus", "eq", "F")], "o_orderstatus = 'F'", ("o_orderpriority",))
_filter("filter_ne", "orders", [_f("o_orderstatus", "ne", "F")], "o_orderstatus <> 'F'", ("o_orderpriority",))
_filter("filter_gt", "lineitem", [_f("l_quantity", "gt", 25)], "l_quantity > 25", ("l_returnflag",))
_filter("filter_gte", "lineitem", [_f("l_quantity", "gte", "25")], "l_quantity >= 25", ("l_returnflag",))
_filter("filter_lt", "lineitem", [_f("l_quantity", "lt", 25)], "l_quantity < 25", ("l_returnflag",))
_filter("filter_lte", "lineitem", [_f("l_quantity", "lte", "$25")], "l_quantity <= 25", ("l_returnflag",))
_filter("filter_ne_null", "customer", [_f("c_mktsegment", "ne", None)], "c_mktsegment IS NOT NULL", ("c_mktsegment",))
_filter("filter_eq_null", "customer", [_f("c_mktsegment", "eq", None)], "false")
_filter("filter_lt_null", "lineitem", [_f("l_quantity", "lt", None)], "l_quantity IS NOT NULL")
_filter("filter_contains_ci", "part", [_f("p_name", "contains", "A")], "contains(lower(p_name), 'a')", ("p_brand",))
_filter("filter_starts_with_ci", "customer", [_f("c_mktsegment", "starts_with", "b")], "starts_with(lower(c_mktsegment), 'b')", ("c_mktsegment",))
_filter("filter_contains_number", "part", [_f("p_size", "contains", "1")], "contains(CAST(p_size AS VARCHAR), '1')", ("p_size",))
_filter("filter_contains_date", "orders", [_f("o_orderdate", "contains", "99")], "contains(CAST(epoch_ms(o_orderdate) AS VARCHAR), '99')", ("o_orderstatus",))
_filter("filter_in", "events", [_f("event_type", "in", ["click", "view", "purchase"])], "event_type IN ('click', 'view', 'purchase')", ("event_type",))
_filter("filter_is_null", "customer", [_f("c_mktsegment", "is_null")], "c_mktsegment IS NULL")
_filter("filter_is_not_null", "customer", [_f("c_mktsegment", "is_not_null")], "c_mktsegment IS NOT NULL", ("c_nationkey",))
_filter("filter_date_gte", "orders", [_f("o_orderdate", "gte", "1996-01-01")], "o_orderdate >= TIMESTAMP '1996-01-01'", ("o_orderstatus",))
_filter("filter_date_offset", "orders", [_f("o_orderdate", "lt", "1996/01/01T05:30:00+0530")], "o_orderdate < TIMESTAMP '1996-01-01'", ("o_orderstatus",))
_filter("filter_conjunction", "lineitem", [_f("l_quantity", "gte", 10), _f("l_returnflag", "in", ["A", "R"]), _f("l_shipdate", "lt", "1997-01-01")], "l_quantity >= 10 AND l_returnflag IN ('A', 'R') AND l_shipdate < TIMESTAMP '1997-01-01'", ("l_linestatus",))

_holed = lambda df: df.withColumn("price", F.expr("CASE WHEN l_quantity <= 45 THEN l_extendedprice END"))
HOLED = "(SELECT *, CASE WHEN l_quantity <= 45 THEN l_extendedprice END AS price FROM lineitem)"
_segment = lambda df: df.withColumn("segment", F.expr("CASE WHEN c_nationkey >= 5 THEN c_mktsegment END"))
SEGMENT = "(SELECT *, CASE WHEN c_nationkey >= 5 THEN c_mktsegment END AS segment FROM customer)"


def _a(op: str, column: str, name: str) -> dict:
    return {"op": op, "column": column, "as": name}


_add("filter_in_with_null", "customer", f"SELECT segment, count(*) AS n FROM {SEGMENT} WHERE segment IN ('BUILDING') OR segment IS NULL GROUP BY 1", change=_segment, where=[_f("segment", "in", ["BUILDING", None])], group_by=["segment"], aggregate=COUNT)
_add("filter_ne_skips_null", "customer", f"SELECT segment, count(*) AS n FROM {SEGMENT} WHERE segment <> 'BUILDING' GROUP BY 1", change=_segment, where=[_f("segment", "ne", "BUILDING")], group_by=["segment"], aggregate=COUNT)
_add(
    "agg_global_all", "lineitem",
    f"SELECT count(*) AS n, count(DISTINCT price) AS prices, {_r('sum(price)', 'total')}, {_r('avg(price)', 'mean')}, min(price) AS lo, max(price) AS hi, {_r('median(price)', 'mid')} FROM {HOLED}",
    ("total", "mean", "mid"), _holed,
    aggregate=[*COUNT, _a("count_distinct", "price", "prices"), _a("sum", "price", "total"), _a("avg", "price", "mean"), _a("min", "price", "lo"), _a("max", "price", "hi"), _a("median", "price", "mid")],
)
_add("agg_count_column_counts_rows", "lineitem", f"SELECT l_returnflag, count(*) AS n FROM {HOLED} GROUP BY 1", change=_holed, group_by=["l_returnflag"], aggregate=[_a("count", "price", "n")])
_add("agg_count_distinct", "lineitem", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1", group_by=["l_returnflag"], aggregate=[_a("count_distinct", "l_partkey", "parts")])
_add("agg_sum_avg_group", "lineitem", f"SELECT l_returnflag, {_r('sum(price)', 'total')}, {_r('avg(price)', 'mean')} FROM {HOLED} GROUP BY 1", ("total", "mean"), _holed, group_by=["l_returnflag"], aggregate=[_a("sum", "price", "total"), _a("avg", "price", "mean")])
_add("agg_median_group", "orders", f"SELECT o_orderpriority, {_r('median(o_totalprice)', 'mid')} FROM orders GROUP BY 1", ("mid",), group_by=["o_orderpriority"], aggregate=[_a("median", "o_totalprice", "mid")])
_add("agg_minmax_date", "orders", "SELECT o_orderstatus, min(o_orderdate) AS first_day, max(o_orderdate) AS last_day FROM orders GROUP BY 1", group_by=["o_orderstatus"], aggregate=[_a("min", "o_orderdate", "first_day"), _a("max", "o_orderdate", "last_day")])
_add("agg_default_names", "part", "SELECT p_brand, count(*) AS count, max(p_size) AS max_of_p_size FROM part GROUP BY 1", group_by=["p_brand"], aggregate=[{"op": "count"}, {"op": "max", "column": "p_size"}])
_add("group_multi_key", "lineitem", f"SELECT l_returnflag, l_linestatus, count(*) AS n, {_r('sum(l_quantity)', 'quantity')} FROM lineitem GROUP BY 1, 2", ("quantity",), group_by=["l_returnflag", "l_linestatus"], aggregate=[*COUNT, _a("sum", "l_quantity", "quantity")])
_add("group_null_key", "customer", f"SELECT segment, count(*) AS n FROM {SEGMENT} GROUP BY 1", change=_segment, group_by=["segment"], aggregate=COUNT)
_add("empty_match_global", "orders", "SELECT count(*) AS n, sum(o_totalprice) AS total FROM orders WHERE o_totalprice < 0", where=[_f("o_totalprice", "lt", 0)], aggregate=[*COUNT, _a("sum", "o_totalprice", "total")])
_add("empty_match_grouped", "orders", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice < 0 GROUP BY 1", where=[_f("o_totalprice", "lt", 0)], group_by=["o_orderstatus"], aggregate=COUNT)
_by = lambda column, direction: {"column": column, "direction": direction}
_add("order_nulls_last_asc", "customer", f"SELECT segment, count(*) AS n FROM {SEGMENT} GROUP BY 1 ORDER BY segment ASC NULLS LAST LIMIT 5", change=_segment, group_by=["segment"], aggregate=COUNT, order_by=[_by("segment", "asc")], limit=5)
_add("order_nulls_last_desc", "customer", f"SELECT segment, count(*) AS n FROM {SEGMENT} GROUP BY 1 ORDER BY segment DESC NULLS LAST LIMIT 5", change=_segment, group_by=["segment"], aggregate=COUNT, order_by=[_by("segment", "desc")], limit=5)
_add("topk_limit", "orders", f"SELECT o_custkey, count(*) AS n, {_r('sum(o_totalprice)', 'total')} FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 20", ("total",), group_by=["o_custkey"], aggregate=[*COUNT, _a("sum", "o_totalprice", "total")], order_by=[_by("n", "desc"), _by("o_custkey", "asc")], limit=20)
_add("limit_clamped", "orders", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 50", group_by=["o_custkey"], aggregate=COUNT, order_by=[_by("n", "desc"), _by("o_custkey", "asc")], limit=500)


def _kanon(name: str, table: str, k: int, keys: list[str], aggregate: list[tuple[str, str, str, str]], where: list[dict] | None = None, condition: str = "true") -> None:
    """aggregate: (op, column, name, SQL); sums and means are rounded."""
    soft = tuple(n for op, _, n, _ in aggregate if op in ("sum", "avg", "median"))
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    inner = ", ".join([*keys, "count(*) AS n", *(_r(sql, n) if n in soft else f"{sql} AS {n}" for _, _, n, sql in aggregate)])
    outer = ", ".join([*keys, "n", *(n for _, _, n, _ in aggregate)])
    sql = f"WITH f AS (SELECT * FROM {table} WHERE {condition}), g AS (SELECT {inner} FROM f {group}), t AS (SELECT (SELECT count(*) FROM {table}) AS total, (SELECT count(*) FROM f) AS m) SELECT {outer} FROM g, t WHERE {K1.format(k=k)}"
    _add(name, table, sql, soft, where=where or [], group_by=keys, aggregate=[*COUNT, *(_a(op, c, n) for op, c, n, _ in aggregate)], k=k)


_kanon("kanon_group_sum", "lineitem", 5, ["l_returnflag"], [("sum", "l_extendedprice", "amount", "sum(l_extendedprice)"), ("avg", "l_discount", "discount", "avg(l_discount)"), ("median", "l_quantity", "mid", "median(l_quantity)")])
_kanon("kanon_grouped", "lineitem", 5, ["l_shipdate"], [("max", "l_quantity", "most", "max(l_quantity)")])
_kanon("kanon_filtered_group", "lineitem", 5, ["l_shipdate"], [("max", "l_quantity", "most", "max(l_quantity)")], [_f("l_quantity", "gte", 10)], "l_quantity >= 10")
_kanon("kanon_ungrouped", "events", 5, [], [("sum", "value", "amount", "sum(value)")], [_f("event_type", "eq", "click")], "event_type = 'click'")
_kanon("kanon_ungrouped_small", "customer", 5, [], [("max", "c_acctbal", "most", "max(c_acctbal)")], [_f("c_custkey", "lte", 3)], "c_custkey <= 3")
_kanon("kanon_complement", "customer", 5, [], [("max", "c_acctbal", "most", "max(c_acctbal)")], [_f("c_custkey", "gt", 3)], "c_custkey > 3")
_kanon("kanon_zero_match", "customer", 5, [], [("max", "c_acctbal", "most", "max(c_acctbal)")], [_f("c_custkey", "lt", -3)], "c_custkey < -3")
_kanon("kanon_whole_file", "customer", 5, [], [("avg", "c_acctbal", "mean", "avg(c_acctbal)")], [_f("c_custkey", "gte", 0)], "c_custkey >= 0")
_kanon("kanon_two_keys", "events", 10, ["user_id", "event_type"], [("avg", "value", "mean", "avg(value)")])


def _registered(sql: str):
    def add(f: Found) -> Found:
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def _profile_rows(spark: SparkSession, sf_dir: str, table: str, numbers: list[str], change: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The profile's statistics, a row per column."""
    d = _table(spark, sf_dir, table, change)
    fields = [d.find(n) for n in numbers]
    kept = {"lo": lambda c: c.cast("double"), "hi": lambda c: c.cast("double"), "mean": lambda c: half_up(c, 4), "mid": lambda c: half_up(c, 4), "dev": lambda c: half_up(c, 4), "n": lambda c: c, "d": lambda c: c}
    rows = [F.struct(F.lit(f.name).alias("name"), *(read(F.col(f"{n}{i}")).alias(n) for n, read in kept.items())) for i, f in enumerate(fields)]
    return profile.statistics(d, fields).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _numeric_sql(table: str, columns: list[str], source: str = "") -> str:
    r4 = lambda e: f"floor(({e}) * 10000.0 + 0.5) / 10000.0"
    return " UNION ALL ".join(f"SELECT '{c}' AS name, CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi, {r4(f'avg({c})')} AS mean, {r4(f'median({c})')} AS mid, {r4(f'coalesce(stddev_samp({c}), 0.0)')} AS dev, count({c}) AS n, count(DISTINCT {c}) AS d FROM {source or table}" for c in columns)


@_registered(_numeric_sql("part", ["p_size", "p_retailprice"]))
def profile_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile_rows(spark, sf_dir, "part", ["p_size", "p_retailprice"])


@_registered(_numeric_sql("customer", ["c_acctbal", "c_nationkey"]))
def profile_numeric_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile_rows(spark, sf_dir, "customer", ["c_acctbal", "c_nationkey"])


@_registered("SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 5 ORDER BY n DESC, min(event_id) LIMIT 5")
def top_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "events")
    return profile.top_categories(d, d.find("event_type"), 5)


@_registered(_numeric_sql("lineitem", ["price", "l_quantity"], HOLED))
def profile_numeric_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile_rows(spark, sf_dir, "lineitem", ["price", "l_quantity"], _holed)


@_registered("SELECT count(*) AS n, count(price) AS filled, floor((1 - count(price) / count(*)) * 1000.0 + 0.5) / 1000.0 AS rate FROM (SELECT CASE WHEN l_quantity <= 25 THEN l_extendedprice END AS price FROM lineitem) HAVING 1 - count(price) / count(*) >= 0.1")
def anomaly_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "lineitem", lambda df: df.selectExpr("CASE WHEN l_quantity <= 25 THEN l_extendedprice END AS price"))
    counted = anomalies.counts(d, [d.find("price")], same=False).select(F.col("rows").alias("n"), F.col("n0").alias("filled")).withColumn("share", 1 - F.col("filled") / F.col("n"))
    return counted.where(F.col("share") >= anomalies.MISSING_RATE).select("n", "filled", half_up(F.col("share"), 3).alias("rate"))


@_registered("SELECT count(DISTINCT flag) = 1 AS constant, count(DISTINCT l_linestatus) = 1 AS varied FROM (SELECT 'x' AS flag, l_linestatus FROM lineitem)")
def anomaly_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "lineitem", lambda df: df.select(F.lit("x").alias("flag"), "l_linestatus"))
    return anomalies.counts(d, d.fields).select(F.col("same0").alias("constant"), F.col("same1").alias("varied"))


def _outlier_sql(table: str, column: str) -> str:
    return f"WITH q AS (SELECT quantile_cont({column}, 0.25) AS a, quantile_cont({column}, 0.75) AS b FROM {table}), w AS (SELECT a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi FROM q) SELECT count(*) FILTER ({column} < lo) AS below, count(*) FILTER ({column} > hi) AS above, CAST(min({column}) FILTER ({column} < lo) AS DOUBLE) AS lowest, CAST(max({column}) FILTER ({column} > hi) AS DOUBLE) AS highest FROM {table}, w"


def _outliers(spark: SparkSession, sf_dir: str, table: str, column: str) -> DataFrame:
    d = _table(spark, sf_dir, table)
    f = d.find(column)
    q1, q3 = anomalies.fences(d, [f]).first().q0
    found = d.df.agg(*anomalies.beyond(f.column, q1 - anomalies.FENCE * (q3 - q1), q3 + anomalies.FENCE * (q3 - q1)))
    return found.toDF("below", "above", "lowest", "highest")


@_registered(_outlier_sql("documents", "n_chars"))
def anomaly_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outliers(spark, sf_dir, "documents", "n_chars")


@_registered(_outlier_sql("events", "value"))
def anomaly_outliers_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outliers(spark, sf_dir, "events", "value")


@_registered("WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE month(o_orderdate) <> 2), s AS (SELECT d, d - lag(d) OVER (ORDER BY d) AS step FROM d) SELECT count(*) AS days, count(*) FILTER (step > 1) AS gaps, CAST(max(step) FILTER (step > 1) AS INTEGER) AS longest FROM s")
def anomaly_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "orders", lambda df: df.where("month(o_orderdate) <> 2"))
    return anomalies.day_gaps(d.df.select(F.to_date(d.find("o_orderdate").column).alias("day"))).select("days", "gaps", "longest")


@_registered("SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_rows FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)")
def anomaly_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomalies.duplicate_rows(_table(spark, sf_dir, "events", lambda df: df.select("user_id", "event_type")))


@_registered("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN -l_quantity ELSE l_quantity END AS number, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_returnflag = 'R' END AS flag, CASE WHEN l_linenumber = 7 THEN NULL ELSE date_trunc('day', l_shipdate) END AS day FROM lineitem")
def coerce_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed cells printed as messy text and read back."""
    table = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate")
    cells = spread(table).selectExpr(
        "l_orderkey", "l_linenumber",
        "CASE WHEN l_linenumber = 7 THEN ' N/A ' WHEN l_linenumber = 6 THEN concat('($', format_number(l_quantity, 2), ')') ELSE concat(' $', format_number(l_quantity, 2)) END AS number",
        "CASE WHEN l_linenumber = 7 THEN 'null' WHEN l_returnflag = 'R' THEN ' YES' ELSE 'False' END AS flag",
        "CASE WHEN l_linenumber = 7 THEN '' WHEN l_linenumber < 3 THEN date_format(l_shipdate, 'yyyy/MM/dd') ELSE date_format(l_shipdate, \"yyyy-MM-dd'T'00:00:00'Z'\") END AS day",
    )
    return coerce.coerce_columns(cells, {"number": NUMBER, "flag": BOOLEAN, "day": DATE}).withColumn("day", F.col("day").cast("timestamp_ntz"))


_filter("filter_boolean_text", "orders", [_f("late", "eq", " YES ")], "o_orderdate >= TIMESTAMP '1996-01-01'", ("o_orderstatus",), lambda df: df.withColumn("late", F.expr("o_orderdate >= timestamp_ntz'1996-01-01'")))
_filter("filter_contains_null_free", "customer", [_f("segment", "starts_with", "")], "c_nationkey >= 5", change=_segment)


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A result that the driver holds anyway, such as what a tool answers."""
    return spark.createDataFrame(rows, schema)


TOTALS = "SELECT count(*) AS total_groups, count(*) > 20 AS truncated FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 5)"


@_registered(TOTALS)
def query_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that may be shown, before the limit. The complements hide none here, as all of them are large."""
    r = run_query(_table(spark, sf_dir, "orders"), {"groupBy": ["o_custkey"], "aggregate": [{"op": "count"}], "minGroupSize": 5})
    return _rows(spark, [(r.total_groups, r.truncated)], "total_groups long, truncated boolean")


@_registered(f"SELECT name FROM (SELECT 'price' AS name, count(*) > count(price) AS blank FROM {HOLED} UNION ALL SELECT 'l_tax', count(*) > count(l_tax) FROM lineitem) WHERE blank")
def blanks_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"groupBy": ["l_returnflag"], "aggregate": [_a("sum", "price", "a"), _a("avg", "l_tax", "b"), _a("count_distinct", "price", "c")]}
    return _rows(spark, [(n,) for n in run_query(_table(spark, sf_dir, "lineitem", _holed), spec).blanks_skipped], "name string")


MASK = "CASE WHEN n < 5 AND n <> total THEN 'fewer than 5' ELSE CAST(n AS VARCHAR) END"


@_registered(" UNION ALL ".join(f"SELECT {key} AS below, {MASK} AS matched FROM (SELECT count(*) FILTER (c_custkey < {key}) AS n, count(*) AS total FROM customer)" for key in (1, 4, 40)))
def matched_rows_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark)
    w.load_parquet(f"{sf_dir}/customer.parquet")
    ask = lambda key: w.call("query_dataset", {"dataset": "customer", "where": [_f("c_custkey", "lt", key)], "aggregate": COUNT})["matchedRows"]
    return _rows(spark, [(key, str(ask(key))) for key in (1, 4, 40)], "below int, matched string")


@_registered(
    "SELECT kind, name, severity FROM (SELECT 'missing' AS kind, 'price' AS name, CASE WHEN count(price) <= 0.5 * count(*) THEN 'warning' ELSE 'info' END AS severity, count(price) <= 0.9 * count(*) AS found FROM (SELECT CASE WHEN l_quantity <= 25 THEN l_extendedprice END AS price FROM lineitem)"
    " UNION ALL SELECT 'constant', 'flag', 'info', true UNION ALL SELECT 'duplicates', NULL, CASE WHEN count(*) - count(DISTINCT (l_returnflag, CASE WHEN l_quantity <= 25 THEN l_quantity END)) >= 0.05 * count(*) THEN 'warning' ELSE 'info' END, true FROM lineitem) WHERE found",
)
def anomalies_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    change = lambda df: df.selectExpr("'x' AS flag", "l_returnflag", "CASE WHEN l_quantity <= 25 THEN l_quantity END AS price")
    d = _table(spark, sf_dir, "lineitem", change)
    found = anomalies.detect_anomalies(d, None, ["missing", "constant", "duplicates"])
    return _rows(spark, [(a["kind"], a.get("column"), a["severity"]) for a in found], "kind string, name string, severity string")


def _categories_sql(table: str, column: str, key: str) -> str:
    named = f"(SELECT string_agg(v || '=' || n, ';' ORDER BY n DESC, f) FROM (SELECT {column} AS v, count(*) AS n, min({key}) AS f FROM {table} GROUP BY 1 HAVING count(*) >= 5 ORDER BY n DESC, f LIMIT 5))"
    return f"SELECT '{column}' AS name, count(*) AS n, count(*) - count({column}) AS nulls, count(DISTINCT {column}) AS d, CASE WHEN count(DISTINCT {column}) > 50 OR count(DISTINCT {column}) > 0.5 * count({column}) THEN 'withheld' ELSE coalesce({named}, 'withheld') END AS categories FROM {table}"


TEXT_COLUMNS = [("events", "event_type", "event_id"), ("part", "p_brand", "p_partkey"), ("part", "p_name", "p_partkey"), ("documents", "source", "doc_id"), ("documents", "lang", "doc_id"), ("customer", "c_name", "c_custkey")]


@_registered(" UNION ALL ".join(_categories_sql(*c) for c in TEXT_COLUMNS))
def profile_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of text columns: their commonest values, or that these are withheld."""
    rows = []
    for table, column, _ in TEXT_COLUMNS:
        p = profile.profile_dataset(_table(spark, sf_dir, table), [column], 5)[0]
        shown = ";".join(f"{c['value']}={c['count']}" for c in p["topCategories"]) if "topCategories" in p else "withheld"
        rows.append((column, p["count"], p["nulls"], p["distinct"], shown))
    return _rows(spark, rows, "name string, n long, nulls long, d long, categories string")


DATE_COLUMNS = [("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts")]


@_registered(" UNION ALL ".join(f"SELECT '{c}' AS name, count(*) AS n, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS d, min({c}) AS lo, max({c}) AS hi FROM {t}" for t, c in DATE_COLUMNS))
def profile_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for table, column in DATE_COLUMNS:
        p = profile.profile_dataset(_table(spark, sf_dir, table), [column], 5)[0]
        rows.append((column, p["count"], p["nulls"], p["distinct"], p["min"], p["max"]))
    return _rows(spark, rows, "name string, n long, nulls long, d long, lo timestamp_ntz, hi timestamp_ntz")


def _workspace(spark: SparkSession, sf_dir: str, *tables: str, **settings) -> Workspace:
    w = Workspace(spark, **settings)
    for t in tables:
        w.load_parquet(f"{sf_dir}/{t}.parquet")
    return w


@_registered("SELECT 'customer' AS id, count(*) AS n, 'number,string,number,number,string' AS types FROM customer UNION ALL SELECT 'orders', count(*), 'number,number,string,number,date,string' FROM orders UNION ALL SELECT 'embeddings', count(*), 'number,number' FROM embeddings")
def tool_list_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _workspace(spark, sf_dir, "customer", "orders", "embeddings").call("list_datasets")["datasets"]
    return _rows(spark, [(d["id"], d["rows"], ",".join(c["type"] for c in d["columns"])) for d in found], "id string, n long, types string")


@_registered(_numeric_sql("customer", ["c_acctbal", "c_custkey"]))
def tool_describe_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _workspace(spark, sf_dir, "customer").call("describe_columns", {"dataset": "customer", "columns": ["c_acctbal", "c_custkey"]})["profiles"]
    rows = [(p["name"], *(float(p[k]) for k in ("min", "max", "mean", "medianValue", "stdDev")), p["count"] - p["nulls"], p["distinct"]) for p in found]
    return _rows(spark, rows, "name string, lo double, hi double, mean double, mid double, dev double, n long, d long")


@_registered(f"SELECT 'outliers' AS kind, 'value' AS name, below, above FROM ({_outlier_sql('events', 'value')}) WHERE below + above > 0 UNION ALL SELECT 'outliers', 'n_chars', below, above FROM ({_outlier_sql('documents', 'n_chars')}) WHERE below + above > 0")
def tool_detect_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, rows = _workspace(spark, sf_dir, "events", "documents"), []
    for dataset, column in (("events", "value"), ("documents", "n_chars")):
        for a in w.call("detect_anomalies", {"dataset": dataset, "columns": [column], "kinds": ["outliers"]})["anomalies"]:
            rows.append((a["kind"], a["column"], a["detail"]["below"], a["detail"]["above"]))
    return _rows(spark, rows, "kind string, name string, below long, above long")


@_registered("SELECT c_custkey, c_name, CAST(c_acctbal AS DOUBLE) AS c_acctbal FROM customer ORDER BY c_custkey LIMIT 5")
def tool_sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows, once a person agreed; that there are only a few is the tool's point."""
    w = _workspace(spark, sf_dir, "customer", approve=lambda request: True, trust="raw")
    found = w.call("sample_rows", {"dataset": "customer", "reason": "how names are spelled", "rows": 5, "columns": ["c_custkey", "c_name", "c_acctbal"]})
    return _rows(spark, [(r[0], r[1], float(r[2])) for r in found["rows"]], "c_custkey long, c_name string, c_acctbal double")


@_registered("SELECT o_orderpriority AS label, CAST(count(*) AS DOUBLE) AS value, filtered FROM (SELECT *, false AS filtered FROM orders UNION ALL SELECT *, true FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01') GROUP BY o_orderpriority, filtered HAVING count(*) >= 5")
def tool_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chart's points before and after the report is filtered."""
    w = _workspace(spark, sf_dir, "orders")
    block = w.call("add_chart", {"dataset": "orders", "title": "Orders", "type": "bar", "groupBy": "o_orderpriority", "aggregate": {"op": "count"}})["blockId"]
    rows = [(p["label"], p["value"], False) for p in w.chart_points(block)]
    w.call("set_report_filter", {"dataset": "orders", "where": [_f("o_orderdate", "gte", "1996-01-01")]})
    rows += [(p["label"], p["value"], True) for p in w.chart_points(block)]
    return _rows(spark, rows, "label string, value double, filtered boolean")


@_registered(" UNION ALL ".join(f"SELECT {key} AS below, {MASK} AS matched, total FROM (SELECT count(*) FILTER (c_custkey < {key}) AS n, count(*) AS total FROM customer)" for key in (1, 4, 40)))
def tool_report_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _workspace(spark, sf_dir, "customer")
    ask = lambda key: w.call("set_report_filter", {"dataset": "customer", "where": [_f("c_custkey", "lt", key)]})
    return _rows(spark, [(key, str((r := ask(key))["matchedRows"]), r["totalRows"]) for key in (1, 4, 40)], "below int, matched string, total long")


def _delimited(spark: SparkSession, sf_dir: str) -> Dataset:
    """All orders, written as quoted text with every kind of cell, and read back as one dataset."""
    path = f"{shared_dir(spark)}/orders-{uuid.uuid4().hex}"
    cells = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(
        "concat(' ', o_orderkey) AS key", "concat(o_orderstatus, '; \"', o_custkey, '\"') AS name", "CASE WHEN o_orderstatus = 'P' THEN 'N/A' ELSE lower(o_orderpriority) END AS `name `",
        "CASE WHEN o_custkey % 50 = 7 THEN 'none of it' WHEN o_custkey % 2 = 1 THEN concat('$', format_number(o_totalprice, 2)) ELSE concat('(', o_custkey + 1, ')') END AS odd",
        "CASE WHEN o_orderstatus = 'F' THEN 'yes' ELSE 'False' END AS flag", "date_format(o_orderdate, CASE WHEN o_custkey % 2 = 1 THEN 'yyyy/MM/dd' ELSE \"yyyy-MM-dd'T'00:00:00'Z'\" END) AS day", "concat('a\\nb', o_custkey % 5) AS text",
    )
    cells.write.option("header", True).option("sep", ";").option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return load_delimited_table(spark, path, "Orders.csv")


@_registered(
    "SELECT CAST(o_orderkey AS DOUBLE) AS key, o_orderstatus || '; \"' || o_custkey || '\"' AS name, CASE WHEN o_orderstatus <> 'P' THEN lower(o_orderpriority) END AS name_2,"
    " CAST(CASE WHEN o_custkey % 50 = 7 THEN NULL WHEN o_custkey % 2 = 1 THEN floor(o_totalprice * 100 + 0.5) / 100 ELSE -o_custkey - 1 END AS DOUBLE) AS odd,"
    " o_orderstatus = 'F' AS flag, date_trunc('day', o_orderdate) AS day, 'a' || chr(10) || 'b' || o_custkey % 5 AS text FROM orders"
)
def delimited_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _delimited(spark, sf_dir)
    return d.df.select(*(F.col(f.physical).alias(f.name) for f in d.fields)).withColumn("day", F.col("day").cast("timestamp_ntz"))


@_registered("SELECT 'odd' AS name, 'number' AS expected, count(*) FILTER (o_custkey % 50 = 7) AS invalid FROM orders")
def anomaly_type_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = anomalies.detect_anomalies(_delimited(spark, sf_dir), kinds=["type_violations"])
    return _rows(spark, [(a["column"], a["detail"]["expectedType"], a["detail"]["invalid"]) for a in found], "name string, expected string, invalid long")


TEXTS = {
    "number": "format_number(l_extendedprice, 2)", "mostly": "CASE WHEN l_quantity = 1 THEN 'one' ELSE cast(l_quantity AS string) END", "rarely": "CASE WHEN l_quantity <= 5 THEN 'few' ELSE cast(l_quantity AS string) END",
    "day": "date_format(l_shipdate, 'yyyy-MM-dd')", "flag": "CASE WHEN l_tax > 0.04 THEN 'Yes' WHEN l_tax > 0.02 THEN ' no' ELSE 'n/a' END", "digit": "CASE WHEN l_tax > 0.04 THEN '1' ELSE '0' END",
    "word": "l_returnflag", "blank": "CASE WHEN l_tax > 0.04 THEN ' null' ELSE '' END",
}


@_registered(
    "SELECT name, CASE WHEN share >= 0.95 THEN kind ELSE 'string' END AS kind FROM (SELECT 'number' AS name, 'number' AS kind, 1.0 AS share UNION ALL SELECT 'mostly', 'number', count(*) FILTER (l_quantity <> 1) / count(*) FROM lineitem"
    " UNION ALL SELECT 'rarely', 'number', count(*) FILTER (l_quantity > 5) / count(*) FROM lineitem UNION ALL SELECT 'day', 'date', 1 UNION ALL SELECT 'flag', 'boolean', 1 UNION ALL SELECT 'digit', 'number', 1 UNION ALL SELECT 'word', 'string', 1 UNION ALL SELECT 'blank', 'string', 1)"
)
def infer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*(f"{sql} AS {n}" for n, sql in TEXTS.items()))
    return _rows(spark, list(coerce.infer_types(cells, list(TEXTS)).items()), "name string, kind string")
