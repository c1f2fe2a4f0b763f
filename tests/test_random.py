"""Random queries against SQL in DuckDB, with and without the group-size rule."""

import datetime as dt
import random

import duckdb
import pytest

from gatedframe.plans.query import query_frame, run_query
from gatedframe.sources.parquet import load_parquet

PATH = "/root/testdata/sf0.001/lineitem.parquet"
KEYS = ["l_returnflag", "l_linestatus", "l_linenumber", "l_shipdate", "l_suppkey"]
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber", "l_partkey"]
SIGNS = {"eq": "=", "ne": "<>", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{PATH}'")
    return con


@pytest.fixture(scope="module")
def lineitem(spark):
    return load_parquet(spark, PATH)


def quoted(v):
    return f"'{v}'" if isinstance(v, str) else str(v)


def random_filter(rng):
    kind = rng.randrange(5)
    if kind == 0:
        op, column = rng.choice(list(SIGNS)), rng.choice(["l_quantity", "l_linenumber", "l_discount"])
        v = rng.choice([1, 3, 25, 49.0, 0.05])
        return {"column": column, "op": op, "value": v}, f"{column} {SIGNS[op]} {v}"
    if kind == 1:
        op, v = rng.choice(list(SIGNS)), rng.choice(["A", "N", "R", "Z"])
        return {"column": "l_returnflag", "op": op, "value": v}, f"l_returnflag {SIGNS[op]} '{v}'"
    if kind == 2:
        op, day = rng.choice(["gt", "gte", "lt", "lte"]), dt.date(1992, 1, 1) + dt.timedelta(days=rng.randrange(2500))
        return {"column": "l_shipdate", "op": op, "value": day.isoformat()}, f"l_shipdate {SIGNS[op]} TIMESTAMP '{day}'"
    if kind == 3:
        values = rng.sample(["A", "N", "R", "Q"], rng.randrange(1, 4))
        return {"column": "l_returnflag", "op": "in", "value": values}, f"l_returnflag IN ({', '.join(map(quoted, values))})"
    digit = str(rng.randrange(10))
    return {"column": "l_partkey", "op": rng.choice(["contains", "starts_with"]), "value": digit}, None


def random_query(rng):
    where, conditions = [], ["true"]
    for _ in range(rng.randrange(4)):
        spec, sql = random_filter(rng)
        where.append(spec)
        conditions.append(sql or f"{spec['op']}(CAST(l_partkey AS VARCHAR), '{spec['value']}')")
    keys = rng.sample(KEYS, rng.randrange(3))
    ops = {"count": "count(*)", "count_distinct": "count(DISTINCT {c})", "sum": "sum({c})", "avg": "avg({c})", "min": "min({c})", "max": "max({c})", "median": "median({c})"}
    aggregate = [{"op": op, "column": c, "as": f"a{i}"} for i in range(rng.randrange(1, 4)) for op, c in [(rng.choice(list(ops)), rng.choice(NUMBERS))]]
    values = ", ".join(ops[a["op"]].format(c=a["column"]) + f" AS {a['as']}" for a in aggregate)
    k = rng.choice([1, 1, 3, 5, 20])
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    rule = f"n = total OR NOT (n < {k} OR (m - n > 0 AND m - n < {k}) OR (total - n > 0 AND total - n < {k}))" if k > 1 else "true"
    f = f"SELECT * FROM lineitem WHERE {' AND '.join(conditions)}"
    columns = ", ".join([*keys, *(a["as"] for a in aggregate)])
    sql = f"WITH f AS ({f}), g AS (SELECT {', '.join([*keys, 'count(*) AS n', values])} FROM f {group}), t AS (SELECT (SELECT count(*) FROM lineitem) AS total, (SELECT count(*) FROM f) AS m) SELECT {columns} FROM g, t WHERE {rule}"
    return {"where": where, "groupBy": keys, "aggregate": aggregate, "minGroupSize": k}, sql


def rounded(rows):
    return sorted((["" if v is None else f"{float(v):.6g}" if isinstance(v, (int, float)) else str(v) for v in r] for r in rows))


@pytest.mark.parametrize("seed", range(24))
def test_random_query(lineitem, duck, seed):
    spec, sql = random_query(random.Random(seed))
    want = duck.execute(sql).fetchall()
    got = query_frame(lineitem, spec["where"], spec["groupBy"], spec["aggregate"], k=spec["minGroupSize"]).collect()
    assert rounded(map(tuple, got)) == rounded(want), sql
    limited = run_query(lineitem, spec | {"limit": 7})
    assert limited.total_groups == len(want) and limited.truncated == (len(want) > 7)
    every = rounded(want)
    assert len(limited.rows) == min(7, len(want)) and all(r in every for r in rounded(limited.rows))
