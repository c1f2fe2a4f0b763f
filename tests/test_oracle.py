"""Every registered engine query against its SQL in DuckDB."""

import datetime as dt
import math
import os

import duckdb
import pytest

from gatedframe.queries import ORACLE, QUERIES

DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    return str(round(float(v), 6)) if not math.isnan(v) else "nan"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    order = sorted(df.columns)
    got = sorted([plain(r[c]) for c in order] for r in df.collect())
    cur = duck.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == order
    want = sorted([plain(row[names.index(c)]) for c in order] for row in cur.fetchall())
    assert got == want
