"""Delimited sources, coercion, queries, disclosure, profiles, anomalies and tools over small inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gatedframe.errors import QueryError
from gatedframe.functions.coerce import as_boolean, as_date, as_number, date_value, is_nullish, number_string, number_value
from gatedframe.functions.text import number_text
from gatedframe.model import to_dataset_id, unique_dataset_id
from gatedframe.operators.anomalies import detect_anomalies
from gatedframe.operators.disclosure import identifies
from gatedframe.operators.profile import profile_dataset
from gatedframe.plans.query import Query, run_query
from gatedframe.presentation import format_cell
from gatedframe.sources.delimited import build_dataset, dedupe_header, detect_delimiter
from gatedframe.sources.quoted import tokenize
from gatedframe.tools.output import cap
from gatedframe.tools.schema import check_input, problems, unsupported_keywords
from gatedframe.workspace import TOOLS, Workspace

SALES = "region,rep,amount,closed,closed_on\nNorth,Ana,100,true,2026-01-01\nNorth,Ana,300,false,2026-01-03\nNorth,Bo,,true,2026-01-04\nSouth,Cy,50,true,2026-01-05\nSouth,Cy,70,false,2026-01-20\nSouth,Di,90,yes,2026-01-21\nEast,Ed,10,no,2026-01-22\n"


@pytest.fixture(scope="module")
def sales(spark):
    return build_dataset(spark, "Sales 2026.csv", SALES.encode())


def test_tokenizer():
    assert list(tokenize('a,"b,""c""\nd"e,f\r\n1\r2,', ",")) == [["a", 'b,"c"\nde', "f"], ["1"], ["2", ""]]
    assert list(tokenize('x"y"z,"open', ",")) == [['x"y"z', "open"]]
    assert list(tokenize("", ",")) == [] and list(tokenize("a\n", ",")) == [["a"]]


def test_delimiter_and_header():
    assert [detect_delimiter(t) for t in ("a,b", "a\tb\tc,d", 'a;"x,y,z";b', "a|b", "ab")] == [",", "\t", ";", "|", ","]
    assert dedupe_header(["id", "", "id"])[0] == ["id", "column_2", "id_2"]
    assert (to_dataset_id("My File (1).csv"), to_dataset_id("!!.csv"), unique_dataset_id("a", ["a", "a_2"])) == ("my_file_1", "dataset", "a_3")


def test_build_dataset(spark, sales):
    assert (sales.id, sales.row_count, [f.type for f in sales.fields]) == ("sales_2026", 7, ["string", "string", "number", "boolean", "date"])
    messy = build_dataset(spark, "m.csv", "﻿ id ,n\n1,2,3\n\n4\n5,x\n".encode())
    assert (messy.names, messy.row_count, len(messy.warnings)) == (["id", "n"], 3, 2)
    assert build_dataset(spark, "one.csv", b"n\n1\n\n2\n").row_count == 2
    assert build_dataset(spark, "e.csv", b"").fields == []
    cut = build_dataset(spark, "c.csv", b"n\n1\n2\n3\n", most_rows=2)
    assert (cut.row_count, cut.source_row_count) == (2, 3) and cut.warnings


def test_coercion(spark):
    numbers = {"1,234.56": 1234.56, " $1,200 ": 1200.0, "₹2,50,000": 250000.0, "(500)": -500.0, "-$40": -40.0, "(-$40)": 40.0, "50%": None, "1.2.3": None, "Infinity": None, "--4": None, "1e999": None, ".5": 0.5, " 7": 7.0}
    dates = {"2026-09-01": dt.datetime(2026, 9, 1), "2026/09/01": dt.datetime(2026, 9, 1), "2026-09-01T13:45:00Z": dt.datetime(2026, 9, 1, 13, 45), "2026-02-31": dt.datetime(2026, 3, 3), "2026-01-01 00:00+0530": dt.datetime(2025, 12, 31, 18, 30), "2026-01-01T00:00:00.1239": dt.datetime(2026, 1, 1, 0, 0, 0, 123000), "03/04/2026": None, "2026-13-01": None, "2026-01-32": None, "2026-01-01\n": dt.datetime(2026, 1, 1)}
    words = {"Yes": True, " false": False, "1": None, "0": None}
    cells = spark.createDataFrame([(t,) for t in [*numbers, *dates, *words, " N/A "]], "t string")
    rows = {r.t: r for r in cells.select("t", as_number(F.col("t")).alias("n"), as_date(F.col("t")).cast("timestamp_ntz").alias("d"), as_boolean(F.col("t")).alias("b"), is_nullish(F.col("t")).alias("z")).collect()}
    assert {t: rows[t].n for t in numbers} == numbers and {t: number_value(t) for t in numbers} == numbers
    assert {t: rows[t].d for t in dates} == dates and {t: date_value(t) for t in dates} == dates
    assert {t: rows[t].b for t in words} == words and rows[" N/A "].z
    texts = {1.0: "1", -2.5: "-2.5", 12345678.5: "12345678.5", 0.1: "0.1", 1e21: "1e+21", 1e-7: "1e-7"}
    made = spark.createDataFrame([(v,) for v in texts], "v double").select("v", number_text(F.col("v")).alias("t")).collect()
    assert {r.v: r.t for r in made} == texts and {v: number_string(v) for v in texts} == texts


def q(dataset, **spec):
    return run_query(dataset, {"aggregate": [{"op": "count"}]} | spec)


def test_queries(sales):
    r = q(sales, groupBy=["region"], aggregate=[{"op": "count"}, {"op": "sum", "column": "amount"}, {"op": "median", "column": "amount"}, {"op": "max", "column": "closed_on"}])
    assert [x[:4] for x in r.rows] == [["North", 3, 400.0, 200.0], ["South", 3, 210.0, 70.0], ["East", 1, 10.0, 10.0]]
    assert r.columns[1:] == [{"name": "count", "type": "number"}, {"name": "sum_of_amount", "type": "number"}, {"name": "median_of_amount", "type": "number"}, {"name": "max_of_closed_on", "type": "date"}]
    assert r.blanks_skipped == ["amount"]
    assert q(sales, where=[{"column": "amount", "op": "lt", "value": None}]).rows == [[6]]
    assert q(sales, where=[{"column": "amount", "op": "in", "value": [50, None]}]).rows == [[2]]
    assert q(sales, where=[{"column": "region", "op": "contains", "value": "TH"}, {"column": "closed", "op": "eq", "value": "yes"}]).rows == [[4]]
    r = q(sales, groupBy=["region"], orderBy=[{"column": "count", "direction": "desc"}], limit=2)
    assert (r.rows, r.truncated, r.total_groups) == ([["North", 3], ["South", 3]], True, 3)
    assert q(sales, where=[{"column": "amount", "op": "gt", "value": 999}], aggregate=[{"op": "count"}, {"op": "sum", "column": "amount"}]).rows == [[0, None]]


@pytest.mark.parametrize("spec, code", [
    ({"aggregate": []}, "no_aggregation"), ({"aggregate": [{"op": "sum"}]}, "invalid_aggregation"), ({"aggregate": [{"op": "sum", "column": "rep"}]}, "type_mismatch"),
    ({"groupBy": ["Region"]}, "unknown_column"), ({"limit": 0}, "invalid_limit"), ({"where": [{"column": "amount", "op": "eq"}]}, "invalid_filter"),
    ({"where": [{"column": "amount", "op": "eq", "value": "x"}]}, "type_mismatch"), ({"orderBy": [{"column": "rep"}]}, "unknown_column"),
])
def test_errors(sales, spec, code):
    with pytest.raises(QueryError) as e:
        q(sales, **spec)
    assert e.value.code == code


def test_disclosure(spark, sales):
    assert [identifies(n, 10, 20, 3) for n in (2, 3, 8, 10)] == [True, False, True, False] and not identifies(2, 2, 2, 3) and not identifies(1, 9, 9, 1)
    assert q(sales, groupBy=["region"], minGroupSize=3).rows == [["North", 3], ["South", 3]]
    assert q(sales, where=[{"column": "region", "op": "eq", "value": "East"}], minGroupSize=2).rows == []
    assert q(sales, where=[{"column": "region", "op": "ne", "value": "East"}], minGroupSize=2).rows == []
    assert q(sales, minGroupSize=50).rows == [[7]]
    lopsided = build_dataset(spark, "l.csv", ("team,amount\n" + "A,1\n" * 6 + "B,2\n").encode())
    assert q(lopsided, groupBy=["team"], minGroupSize=3).rows == []


def test_profiles_and_anomalies(spark, sales):
    region, amount = profile_dataset(sales, ["region", "amount"], 3)
    assert region["topCategories"] == [{"value": "North", "count": 3}, {"value": "South", "count": 3}]
    assert (amount["nulls"], amount["mean"], amount["medianValue"]) == (1, 103.3333, 80.0)
    assert "statisticsWithheld" in profile_dataset(sales, ["amount"], 7)[0]
    kinds = [(a["kind"], a.get("column"), a["severity"]) for a in detect_anomalies(sales)]
    assert kinds == [("gaps", "closed_on", "warning"), ("missing", "amount", "info")]
    values = [*range(1, 17), 500]
    many = build_dataset(spark, "o.csv", ("n,flag\n" + "".join(f"{v},x\n" for v in values) + "1,x\n").encode())
    found = {a["kind"]: a for a in detect_anomalies(many, k=5)}
    assert set(found) == {"outliers", "constant", "duplicates"} and "boundsWithheld" in found["outliers"]["detail"] and found["outliers"]["detail"]["above"] == 1
    assert {a["kind"]: a for a in detect_anomalies(many, k=1)}["outliers"]["detail"]["highestOutlier"] == 500


def test_workspace(spark):
    w = Workspace(spark)
    assert w.available_tools() == ["list_datasets", "add_note"]
    w.load_text("sales.csv", SALES)
    assert len(w.available_tools()) == 8
    w.set_min_group_size(3)
    count = {"dataset": "sales", "groupBy": ["region"], "aggregate": [{"op": "count"}]}
    answer = w.call("query_dataset", count)
    assert answer["rows"] == [["North", 3], ["South", 3]] and answer["totalGroups"] == 2
    absent = w.call("query_dataset", {"dataset": "sales", "where": [{"column": "rep", "op": "eq", "value": "Nobody"}], "aggregate": [{"op": "count"}]})
    hidden = w.call("query_dataset", {"dataset": "sales", "where": [{"column": "rep", "op": "eq", "value": "Di"}], "aggregate": [{"op": "count"}]})
    assert absent == hidden and absent["matchedRows"] == "fewer than 3"
    assert w.call("query_dataset", {"dataset": "sales", "aggregate": [{"op": "nope"}]})["error"]["code"] == "invalid_input"
    assert w.call("query_dataset", {"dataset": "none", "aggregate": [{"op": "count"}]})["error"]["code"] == "unknown_dataset"
    assert w.call("sample_rows", {"dataset": "sales", "reason": "a look at it"})["error"]["code"] == "tool_unavailable"
    chart = w.call("add_chart", {"dataset": "sales", "title": "Regions", "type": "bar", "groupBy": "region", "aggregate": {"op": "count"}})
    assert chart["plotted"] == 2 and len(w.chart_points(chart["blockId"])) == 2
    assert w.call("set_report_filter", {"dataset": "sales", "where": [{"column": "region", "op": "eq", "value": "East"}]})["matchedRows"] == "fewer than 3"
    assert w.chart_points(chart["blockId"]) == []
    w.set_trust("raw")
    assert w.call("sample_rows", {"dataset": "sales", "reason": "a look at it"})["error"]["code"] == "approval_denied"
    w.approve = lambda request: True
    assert w.call("sample_rows", {"dataset": "sales", "reason": "a look at it", "rows": 2, "columns": ["amount", "region"]})["rows"] == [["North", 100], ["North", 300]]
    assert w.call("update_report_block", {"blockId": chart["blockId"], "markdown": "x"})["error"]["code"] == "not_a_note"
    assert w.call("describe_columns", {"dataset": "sales"})["profiles"] and w.call("detect_anomalies", {"dataset": "sales"})["anomalies"]
    assert w.call("clear_workspace", {"confirm": True}) == {"cleared": True} and not w.datasets
    assert w.totals["calls"] == len(w.ledger) and w.totals["rows"] == 2


def test_schema_and_cap():
    assert not [k for t in TOOLS.values() for k in unsupported_keywords(t.schema)]
    assert problems({"type": "object", "properties": {"a": {"type": "integer", "maximum": 3}}, "additionalProperties": False}, {"a": 4, "b": 1}) == [{"path": "input.a", "message": "must be at most 3"}, {"path": "input.b", "message": "is not a known property"}]
    assert check_input({"type": "object"}, {"a": [{"__proto__": 1}]})["code"] == "forbidden_key"
    payload, size, cut = cap({"rows": [["x" * 100]] * 40})
    assert cut and size <= 1500 and payload["outputTruncated"]["available"] == 40
    assert cap({"text": "x" * 2000})[0]["error"]["code"] == "output_too_large"
    assert [format_cell(v, "number") for v in (None, 1234567.0, 0.12345678)] == ["—", "1,234,567", "0.1235"]


def test_a_chart_is_worked_out_once_until_something_changes(spark, monkeypatch):
    runs, run = [], Query.run
    monkeypatch.setattr(Query, "run", lambda self: runs.append(1) or run(self))
    w = Workspace(spark, min_group_size=1)
    w.load_text("t.csv", "k,x\n" + "a,1\nb,2\na,3\nc,4\n" * 3)
    ids = [w.call("add_chart", {"dataset": "t", "title": "T", "type": "bar", "groupBy": "k", "aggregate": {"op": op, "column": "x"}})["blockId"] for op in ("sum", "max")]
    first = [w.chart_points(i) for i in ids]
    assert first == [w.chart_points(i) for i in ids] and len(runs) == 2  # what adding them worked out
    w.call("set_report_filter", {"dataset": "t", "where": [{"column": "x", "op": "gt", "value": 2}]})
    assert [p["label"] for p in w.chart_points(ids[0])] == ["a", "c"] and w.chart_points(ids[0]) and len(runs) == 3
    w.set_min_group_size(4)
    assert w.chart_points(ids[0]) == [] and len(runs) == 4
    w.set_filter("t", None)
    w.set_min_group_size(1)
    assert w.chart_points(ids[0]) == first[0] and len(runs) == 5
    w.remove("t")
    assert not w._drawn
