"""Typed tables: what reaches the scan, the order of rows, blanks that aren't null; and delimited files."""

import datetime as dt
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from gatedframe.errors import QueryError
from gatedframe.functions.text import utf16
from gatedframe.operators import anomalies, quantiles
from gatedframe.plans import query
from gatedframe.plans.query import query_frame, run_query
from gatedframe.queries import QUERIES
from gatedframe.sources import parquet
from gatedframe.sources.parquet import from_frame, load_parquet
from gatedframe.sources.quoted import tokenize
from gatedframe.workspace import Workspace

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def lineitem(spark):
    return load_parquet(spark, f"{SF}/lineitem.parquet")


@pytest.mark.parametrize(
    "where, pushed",
    [
        ({"column": "l_returnflag", "op": "eq", "value": "A"}, "EqualTo(l_returnflag,A)"),
        ({"column": "l_returnflag", "op": "ne", "value": "A"}, "Not(EqualTo(l_returnflag,A))"),
        ({"column": "l_quantity", "op": "gt", "value": 25}, "GreaterThan(l_quantity,25.0)"),
        ({"column": "l_quantity", "op": "gte", "value": "$25"}, "GreaterThanOrEqual(l_quantity,25.0)"),
        ({"column": "l_quantity", "op": "lt", "value": 25}, "LessThan(l_quantity,25.0)"),
        ({"column": "l_shipdate", "op": "lte", "value": "1996-01-01"}, "LessThanOrEqual(l_shipdate,1996-01-01"),
        ({"column": "l_returnflag", "op": "in", "value": ["A", "R"]}, "In(l_returnflag, [A,R])"),
        ({"column": "l_returnflag", "op": "is_null"}, "IsNull(l_returnflag)"),
        ({"column": "l_returnflag", "op": "is_not_null"}, "IsNotNull(l_returnflag)"),
        ({"column": "l_returnflag", "op": "contains", "value": "a"}, "IsNotNull(l_returnflag)"),
    ],
)
def test_filters_reach_the_scan(spark, lineitem, where, pushed):
    found = plan(query_frame(lineitem, where=[where], group_by=["l_linestatus"], aggregate=[{"op": "count"}, {"op": "max", "column": "l_tax"}]))
    assert pushed in found.split("PushedFilters: [", 1)[1].split("], ReadSchema")[0] and "l_partkey" not in found


@pytest.mark.parametrize("name", ["filter_eq", "filter_gt", "filter_conjunction", "filter_date_gte", "kanon_filtered_group"])
def test_registered_filters_reach_the_scan(spark, name):
    assert "PushedFilters: []" not in plan(QUERIES[name](spark, SF)).split("Subquery")[-1].split("FileScan")[-1]


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.startswith("kanon_")))
def test_the_rule_takes_one_scan(spark, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = QUERIES[name](spark, SF)
        found = plan(df)
        assert len(re.findall(r"ReadSchema: struct<\w", found)) == 1, found  # the table's rows are counted from its footers: struct<>
        assert ("ReusedExchange" in found) == ("hashpartitioning" in found)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_run_reads_the_table_once(spark, tmp_path):
    path = str(tmp_path / "counted")
    spark.range(0, 10_000, 1, 2).selectExpr("id % 700 AS k", "IF(id % 3 = 0, NULL, id * 1.0D) AS x").write.parquet(path)
    reads = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(k):
        reads.add(1)
        return k

    d = from_frame(spark.read.parquet(path).withColumn("k", seen(F.col("k"))), "c")
    assert d.row_count == 10_000
    before = reads.value
    r = run_query(d, {"where": [{"column": "k", "op": "gte", "value": 10}], "groupBy": ["k"], "aggregate": [{"op": "sum", "column": "x"}, {"op": "count"}], "minGroupSize": 5, "limit": 20})
    assert (r.matched_rows, r.total_groups, r.truncated, r.blanks_skipped, len(r.rows)) == (9850, 690, True, ["x"], 20)
    assert reads.value - before <= 2 * 10_000  # the filter and the group call it once a row each


def test_building_a_query_reads_nothing(spark):
    d = load_parquet(spark, f"{SF}/orders.parquet")
    frame = query_frame(d, where=[{"column": "o_orderstatus", "op": "eq", "value": "F"}], group_by=["o_orderpriority"], aggregate=[{"op": "count"}], k=5)
    assert d.loaded_rows is None and frame.count() == 5


def test_rows_of_files_keep_their_order(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "several files")
    spark.range(0, 5, 1, 1).selectExpr("id AS x").write.parquet(f"{path}/part-0")
    spark.range(1000, 60_000, 1, 1).selectExpr("id AS x").write.parquet(f"{path}/part-1")
    w = Workspace(spark, approve=lambda request: True, trust="raw", min_group_size=1)
    w.add(from_frame(spark.read.parquet(f"{path}/part-0", f"{path}/part-1"), "t"))
    assert w.call("sample_rows", {"dataset": "t", "reason": "the first rows", "rows": 5})["rows"] == [[0], [1], [2], [3], [4]]
    r = run_query(w.datasets["t"], {"groupBy": ["x"], "aggregate": [{"op": "count"}], "limit": 7})
    assert [x for x, _ in r.rows] == [0, 1, 2, 3, 4, 1000, 1001]
    monkeypatch.setattr(parquet, "MOST_FILES", 1)  # by (path, row) instead of by number
    w.add(from_frame(spark.read.parquet(f"{path}/part-0", f"{path}/part-1"), "u"))
    assert run_query(w.datasets["u"], {"groupBy": ["x"], "aggregate": [{"op": "count"}], "limit": 7}).rows == r.rows
    assert w.call("sample_rows", {"dataset": "u", "reason": "the first rows", "rows": 5})["rows"] == [[0], [1], [2], [3], [4]]
    joined = from_frame(spark.range(3).join(spark.range(3), "id"), "j")
    assert sorted(run_query(joined, {"groupBy": ["id"], "aggregate": [{"op": "count"}]}).rows) == [[0, 1], [1, 1], [2, 1]]


def test_nan_and_infinities_are_blanks(spark, tmp_path):
    path, values = str(tmp_path / "nan"), [1.0, -2.0, None, math.nan, math.inf, -math.inf, 3.0]
    spark.createDataFrame([(v, float(k)) for k, v in enumerate(values)], "x double, y double").coalesce(1).write.parquet(path)
    d = load_parquet(spark, path)
    count = lambda op, *v: run_query(d, {"where": [{"column": "x", "op": op} | ({"value": v[0]} if v else {})], "aggregate": [{"op": "count"}]}).rows[0][0]
    assert [count("gt", 0), count("gte", 3), count("lt", 2), count("lte", 3), count("ne", 1), count("eq", 1), count("ne", None)] == [2, 1, 2, 3, 2, 1, 3]
    assert [count("is_null"), count("is_not_null"), count("in", [1, None])] == [4, 3, 5]
    r = run_query(d, {"aggregate": [{"op": op, "column": "x"} for op in ("count", "count_distinct", "sum", "min", "max", "median")]})
    assert r.rows == [[7, 3, 2.0, -2.0, 3.0, 1.0]] and r.blanks_skipped == ["x"]


def test_text_is_ordered_by_utf16_units(spark):
    texts = ["a", "\U0001f600", "\uff5e", "z", "\ue000", "\ud7ff"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    units = sorted(texts, key=lambda t: t.encode("utf-16-be"))
    assert [r.t for r in df.orderBy(utf16(F.col("t"))).collect()] == units
    d = from_frame(df, "t")
    spec = {"groupBy": ["t"], "aggregate": [{"op": "count"}], "orderBy": [{"column": "t", "direction": "asc"}]}
    assert [t for t, _ in run_query(d, spec).rows] == units
    for v in texts:
        for op, met in (("gt", lambda x, y: x > y), ("lte", lambda x, y: x <= y)):
            got = run_query(d, {"where": [{"column": "t", "op": op, "value": v}], "aggregate": [{"op": "count"}]}).rows[0][0]
            assert got == sum(met(t.encode("utf-16-be"), v.encode("utf-16-be")) for t in texts)


@pytest.mark.parametrize("accuracy, marks", [(20, 5), (100, 10), (100, 400)])
def test_large_medians_are_exact(spark, monkeypatch, accuracy, marks):
    rng = random.Random(7)
    monkeypatch.setattr(quantiles, "MARKS", marks)
    rows = [(rng.choice(["a", "b", None, "c"]), rng.choice([None, 5.0, rng.gauss(0, 1e3), float(rng.randrange(20))])) for _ in range(3000)] + [("one", 1.5), ("none", None), *[("two", float(v)) for v in (1, 4)]]
    df = spark.createDataFrame(rows, "k string, x double").repartition(4)
    fractions = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    usual = {r.k: r.q for r in quantiles.quantiles(df, {"k": F.col("k")}, F.col("x"), fractions, "q", 1).collect()}
    usual_all = quantiles.quantiles(df, {}, F.col("x"), fractions, "q", 1).first().q
    monkeypatch.setattr(quantiles, "IN_MEMORY", 0)
    monkeypatch.setattr(query, "IN_MEMORY", 0)
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    got = {r.k: r.q for r in quantiles.quantiles(df, {"k": F.col("k")}, F.col("x"), fractions, "q", 1).collect()}
    assert set(usual) - set(got) == {"none"} and all(got[k] == pytest.approx(usual[k]) for k in got)
    assert quantiles.quantiles(df, {}, F.col("x"), fractions, "q", 1).first().q == pytest.approx(usual_all)
    rows = run_query(from_frame(df, "m"), {"groupBy": ["k"], "aggregate": [{"op": "median", "column": "x"}, {"op": "count"}]}).rows
    assert {k: m for k, m, _ in rows} == {k: pytest.approx(q[2]) if q else None for k, q in usual.items()}
    assert run_query(from_frame(df, "m"), {"aggregate": [{"op": "median", "column": "x"}]}).rows[0][0] == pytest.approx(usual_all[2])


def test_medians_of_a_hot_group_leave_few_values_to_order(spark, monkeypatch):
    """Half of the rows in one group; of its values some hundredths of a sketch's bracket are put in order, all others are counted."""
    monkeypatch.setattr(quantiles, "IN_MEMORY", 0)
    monkeypatch.setattr(quantiles, "ACCURACY", 500)
    monkeypatch.setattr(quantiles, "MARKS", 50)
    df = spark.range(0, 60_000, 1, 4).selectExpr("IF(id % 2 = 0, 'hot', cast(id % 9 AS string)) AS k", "cast((id * 7919) % 60013 AS double) AS x")
    left = []
    got = {r.k: r.q for r in quantiles.quantiles(df, {"k": F.col("k")}, F.col("x"), [0.5, 0.25], "q", 60_000).collect()}
    want = {r.k: r.q for r in df.groupBy("k").agg(F.percentile("x", F.array(F.lit(0.5), F.lit(0.25))).alias("q")).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    whole = quantiles._within
    monkeypatch.setattr(quantiles, "_within", lambda *a: left.append(whole(*a)) or left[-1])
    quantiles.quantiles(df, {"k": F.col("k")}, F.col("x"), [0.5], "q", 60_000)
    assert left[1].where("k = 'hot'").agg(F.count_distinct("_in")).first()[0] < 600


def test_files_of_a_folder(spark, tmp_path):
    for name, text in (("b.csv", "n\n1\n2\n"), ("a.tsv", "n\tm\n3\t4\n"), ("c.txt", "n|m\n5|6\n")):
        (tmp_path / name).write_text(text)
    w = Workspace(spark)
    assert [(d.id, d.row_count, d.names) for d in w.load_files(str(tmp_path))] == [("a", 1, ["n", "m"]), ("b", 2, ["n"]), ("c", 1, ["n", "m"])]
    assert [d.id for d in w.load_files(str(tmp_path / "*.csv"))] == ["b_2"] and w.load_file(str(tmp_path / "b.csv")).id == "b_3"
    with pytest.raises(QueryError) as e:
        w.load_file(str(tmp_path))
    assert e.value.code == "several_files" and len(w.datasets) == 5
    (tmp_path / "odd").mkdir()
    for name in ("a b%20c.csv", "[x] {y}.csv", "é+ü.csv"):
        (tmp_path / "odd" / name).write_text(f"name\n{name}\n")
    odd = Workspace(spark).load_files(str(tmp_path / "odd"))
    assert sorted(d.df.first().c0 for d in odd) == sorted(d.name for d in odd) == ["[x] {y}.csv", "a b%20c.csv", "é+ü.csv"]
    (tmp_path / "d.exe").write_text("n\n1\n")
    with pytest.raises(QueryError) as e:
        w.load_files(str(tmp_path))
    assert e.value.code == "unsupported_file" and len(w.datasets) == 5
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "empty.csv").write_text("")
    with pytest.raises(QueryError) as e:
        w.load_files(str(tmp_path / "e"))
    assert e.value.code == "empty_file"


def test_tokenizer_keeps_every_row():
    text = "id,text\n" + "".join(f'{i},"line {i}\n""more"""\n' for i in range(20_000))
    rows = list(tokenize(text, ","))
    assert len(rows) == 20_001 and rows[777] == ["776", 'line 776\n"more"']


def test_date_bounds(spark):
    d = from_frame(spark.createDataFrame([(dt.date(2024, 1, k),) for k in range(1, 11)], "day date"), "days")
    assert run_query(d, {"where": [{"column": "day", "op": "gte", "value": "2024-01-08"}], "aggregate": [{"op": "count"}, {"op": "min", "column": "day"}]}).rows == [[3, dt.date(2024, 1, 8)]]


@pytest.mark.parametrize("forced, few", [(False, 500_000), (True, 500_000), (False, 0)])
def test_duplicates_are_told_by_digest_and_then_by_row(spark, monkeypatch, forced, few):
    """Nulls stand where they stand, and rows that share a digest by chance count apart."""
    rng = random.Random(5)
    rows = [(rng.choice([None, "a", "b"]), rng.choice([None, 1.0, math.nan]), rng.choice([None, 2.0])) for _ in range(200)] + [(None, 1.0, None), (None, None, 1.0)]
    d = from_frame(spark.createDataFrame(rows, "t string, x double, y double").repartition(3), "t")
    if forced:
        monkeypatch.setattr(anomalies, "_digest", lambda fields: [F.lit(1).alias("d1"), F.lit(2).alias("d2")])
    monkeypatch.setattr(anomalies, "FEW_DIGESTS", few)
    want = {tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows}
    assert tuple(anomalies.duplicate_rows(d).first()) == (202, len(want))
    single = from_frame(spark.range(50), "s")
    assert tuple(anomalies.duplicate_rows(single).first()) == (50, 50)
    assert tuple(anomalies.duplicate_rows(from_frame(spark.range(0), "e")).first()) == (0, 0)
