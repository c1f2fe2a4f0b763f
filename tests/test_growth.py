"""Steps whose cost per row must not grow with the number of rows, columns or copies of a key."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gatedframe.functions import coerce
from gatedframe.model import BOOLEAN, DATE, NUMBER
from gatedframe.operators import quantiles
from gatedframe.sources import quoted


def test_rows_of_large_groups_are_not_shuffled_for_a_median(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "ACCURACY", 100)
    monkeypatch.setattr(quantiles, "LARGE", 1000)
    rng = random.Random(2)
    sizes = {"a": 5000, "b": 999, "c": 1, None: 1500, "d": 1000}
    rows = [(k, rng.choice([None, rng.random() * 100, float(rng.randrange(5))])) for k, n in sizes.items() for _ in range(n)] + [("e", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, x double")
    found = lambda rows: {r.k: r.q for r in quantiles.quantiles(df, {"k": F.col("k")}, F.col("x"), [0.25, 0.5], "q", rows).collect() if r.q}
    want = {k: v for k, v in found(1).items() if v[0] is not None}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = found(quantiles.IN_MEMORY + 1)
        plan = quantiles.quantiles(df, {"k": F.col("k")}, F.col("x"), [0.5], "q", quantiles.IN_MEMORY + 1)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    assert plan.count("BroadcastHashJoin") >= 4  # of large groups, and of the others without them, twice


def test_the_code_that_tells_types_is_one_for_all_columns(spark):
    cells = ["", " null", "n/a", None, "yes", " No ", "true", "2020-01-31", "2020/02/31", " 2021-01-01T10:00:00.5+0530 ", "2020-13-01", "1999-1-1", "12", "-$1,200.5", "($ 3)", "(4)", ".5", "+7", "€ 8", "1e5", "1e999", "5%", "one", "()", "(x)", "0000-01-01", "- £9", "﻿7"]
    df = spark.createDataFrame([(c, "x", "1") for c in cells], "a string, b string, c string")
    seen = coerce.type_counts(df, ["a", "b", "c"]).first()
    filled = [c for c in cells if c is not None and coerce.trim(c).lower() not in coerce.NULLISH]
    reads = {BOOLEAN: [c for c in filled if coerce.filter_value(c, BOOLEAN)[0]], NUMBER: [c for c in filled if coerce.number_value(c) is not None]}
    read = df.select(*(F.count_if(coerce.coerce(F.col("a"), kind).isNotNull()) for kind in (BOOLEAN, DATE, NUMBER))).first()
    assert [seen["0_0"], seen["0_1"], seen["0_3"]] == [len(filled), len(reads[BOOLEAN]), len(reads[NUMBER])] and tuple(read) == tuple(seen[f"0_{j}"] for j in (1, 2, 3))
    assert [seen[f"1_{j}"] for j in range(4)] == [len(cells), 0, 0, 0] and [seen[f"2_{j}"] for j in range(4)] == [len(cells), 0, 0, len(cells)]
    patterns = lambda *columns: coerce.type_counts(df, list(columns))._jdf.queryExecution().optimizedPlan().toString().count("RLIKE")
    assert patterns("a", "b", "c") == patterns("a")
    assert [coerce.type_counts(df.limit(0), ["a"]).first()[f"0_{j}"] for j in range(4)] == [0] * 4


def made(rng):
    cell = lambda: rng.choice(["", "a", "bc", '"a\n""b;"', '""', '"x"y', 'z"', '"\n\n"', "é", '"a;\r\nb"'])
    return "".join(";".join(cell() for _ in range(rng.randrange(1, 4))) + rng.choice(["\n", "\n", "\r\n", "\r", "\n\n"]) for _ in range(rng.randrange(1, 40)))


def cut(lines, sizes):
    cutter, out = quoted._Cutter(quoted.grammar(";", "\n"), ("f", 0), False, True, True), []
    at = 0
    for n in sizes:
        if part := lines[at : at + n]:
            out += [r for b in cutter.lines(pa.array(part, pa.binary())) for r in b.to_pylist()]
        at += n
    return [(r["idx"], r["kind"], r["fields"]) for r in out + cutter.finished().to_pylist()]


def test_lines_cut_at_once_are_cut_as_one_by_one(monkeypatch):
    rng = random.Random(5)
    for _ in range(300):
        text = made(rng)
        lines = (text if text.endswith("\n") else text + "\n").encode().split(b"\n")[:-1]
        sizes = [rng.randrange(1, 12) for _ in lines]
        got = cut(lines, sizes)
        with monkeypatch.context() as m:
            m.setattr(quoted._Cutter, "_closed", lambda self, values: 0)
            assert got == cut(lines, sizes)


def test_quotes_are_followed_through_a_batch_by_two_matches(monkeypatch):
    rng = random.Random(6)
    g = quoted.grammar(";", "\n")
    for _ in range(200):
        lines = made(rng).encode().split(b"\n")
        want = [False, True]
        for line in lines:
            want = [g.ends_inside(line, w) for w in want]
        calls = []
        with monkeypatch.context() as m:
            m.setattr(quoted.Grammar, "ends_inside", lambda self, line, inside, f=quoted.Grammar.ends_inside: calls.append(line) or f(self, line, inside))
            n = len(lines)
            batch = pa.RecordBatch.from_arrays([pa.array(["f"] * n), pa.array([0] * n, pa.int64()), pa.array([99] * n, pa.int64()), pa.array(lines, pa.binary())], ["key", "start", "size", "value"])
            (found,) = quoted._ends({}, g)([batch])
        assert [found.column("outside")[0].as_py(), found.column("inside")[0].as_py()] == want and len(calls) <= 2
