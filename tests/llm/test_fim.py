"""Fill-in-middle against brute force and SQL, over rows with nulls, repeats, sentinels, empty and very long texts."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from gatedframe.llm import fim, queries

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n, d = len(units), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 50:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    spm = h4 % 100 < 80
    output = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return (doc_id, n, "spm" if spm else "psm", len(prefix), len(middle), sha(output), sha(text))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["a", "été", "𝄞x", "<", "P>", "<S", "S>", "M", " ", " y", "<P", "x" * 50]
    gaps = [" ", "\n", "\t\t", " \r\n", "\x0b", "\x0c"]
    out = [(i, t) for i, t in enumerate([None, "", " ", "\n\t \n", "one", " one", "one ", "a <P> b", "x<M>", "<S>"])]
    out += [(100 + i, "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(0, 60)))) for i in range(300)]
    out += [(7, "again the same id"), (None, "no id at all"), (None, None), (-5, "below zero or so")]
    out += [(1000 + i, "a copied text of some words") for i in range(30)]
    return out + [(2000 + i, "long " * 300_000 + " \n" * i) for i in range(4)] + [(3000 + i, "x" * 1_000_000) for i in range(3)] + [(4000 + i, " " * 500_000) for i in range(3)]


@pytest.fixture(scope="module")
def found(spark, rows, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("fim"))
    spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, FIM string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_query_is_brute_force(spark, rows, found):
    got = [tuple(r) for r in queries.op11_fim(spark, found).collect()]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=key) == sorted((brute(*r) for r in rows), key=key)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_query_is_its_sql(spark, found):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{found}/documents.parquet/*.parquet'")
    got, want = queries.op11_fim(spark, found), db.execute(queries.OP11_SQL)
    assert got.columns == [c[0] for c in want.description]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want.fetchall()))


def test_clashing_names_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "y")], "doc_id long, text string, Fim string, fim_ string")
    made = fim.transform(docs)
    assert made.columns == ["doc_id", "text", "Fim", "fim_", "fim__"]
    assert fim.transform(docs.where("false")).count() == 0


@pytest.mark.parametrize("sentinels", [("", "b", "c"), ("aa", "b", "c"), ("ab", "bc", "d"), ("a", "xay", "c"), ("<P>", "<P>", "<M>")])
def test_sentinels_that_can_be_mistaken_are_refused(spark, sentinels):
    with pytest.raises(ValueError, match="sentinels"):
        fim.transform(spark.range(1).selectExpr("id AS doc_id", "'x' AS text"), sentinels=sentinels)


def test_other_sentinels_and_shares(spark, rows):
    marks = ("<|prefix|>", "<|suffix|>", "<|middle|>")
    made = fim.transform(spark.createDataFrame(rows, "doc_id long, text string"), seed=7, fim_percent=100, spm_percent=30, sentinels=marks)
    restored = fim.restore(F.col("fim.output"), F.col("fim.form"), marks)
    got = made.select(F.coalesce("text", F.lit("")).alias("text"), "fim.form", restored.alias("restored")).collect()
    assert all(r.restored == r.text and (r.form == "plain") == (r.text == "") for r in got) and {r.form for r in got} == {"plain", "psm", "spm"}


def test_output_that_is_not_an_arrangement_gives_null(spark):
    cases = [("a<P>b", "psm"), ("<P>a<S>b", "psm"), ("<S>a<P>b<M>c", "psm"), ("<P>a<S>b<M>c<M>d", "psm"), ("<P>a<S>b<M>c", "spm"), ("<P>a<M>b<S>c", "psm"), (None, "psm")]
    df = spark.createDataFrame(cases, "output string, form string").select(fim.restore(F.col("output"), F.col("form")).alias("t"))
    assert [r.t for r in df.collect()] == [None] * len(cases)


def test_nothing_is_shuffled_and_no_python_runs(spark, found):
    plan = queries.op11_fim(spark, found)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    assert plan.count("regexp_extract_all(") == 1
