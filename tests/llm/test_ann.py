"""The graph index against brute force: recall, exact scores, copies, ties, rows that take no part."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatedframe.llm import ann, queries

SCHEMA = "vec_id long, embedding array<float>, label int, d1 string, vector string"


def brute(rows, k=20, every=20):
    """{query: [(vec_id, score)]} for rows with one usable vector an id."""
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32).astype(float)
    out = {}
    for at in np.flatnonzero(ids % every == 0):
        scores = x @ x[at]
        order = np.lexsort((ids, -scores))
        out[int(ids[at])] = [(int(ids[i]), scores[i]) for i in order if ids[i] != ids[at]][:k]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(4)


def recall(got, want):
    assert got.keys() == want.keys()
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / max(1, len(want[q])) for q in want])


def vectors(n, d=24, centres=8, seed=0, spread=0.6):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, d))
    x = middle[rng.integers(centres, size=n)] + spread * rng.normal(size=(n, d))
    return [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]


def test_recall_and_scores_on_the_table(spark, tmp_path):
    """The whole table of sf0.1; its recall must be 0.9 at least."""
    got = found(queries.op13_nearest(spark, "/root/testdata/sf0.1"))
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    want = brute(rows)
    assert recall(got, want) >= 0.95
    scores = {(q, i): s for q in want for i, s in want[q]}
    for q, near in got.items():
        assert len(near) == 20 and near == sorted(near, key=lambda p: (-p[1], p[0]))
        assert all(math.isclose(s, scores[q, i], rel_tol=1e-12) for i, s in near if (q, i) in scores)


def test_vectors_of_any_length_in_several_shards(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAST_ROWS", 300)
    rng = random.Random(1)
    rows = [(i, [rng.choice([0.1, 1, 1, 3]) * x for x in v]) for i, v in vectors(1500)]
    rows = [(i, np.array(v, np.float32).tolist()) for i, v in rows]
    got, want = found(ann.nearest(table(spark, rows), F.col("vec_id") % 20 == 0)), brute(rows)
    assert recall(got, want) >= 0.9


def test_shard_queries_in_blocks_give_the_same(spark, monkeypatch):
    rows = table(spark, vectors(600)).cache()
    once = found(ann.nearest(rows, F.col("vec_id") % 5 == 0))
    monkeypatch.setattr(ann, "QUERY_BLOCK", 25)
    assert found(ann.nearest(rows, F.col("vec_id") % 5 == 0)) == once


def test_a_third_of_all_rows_is_one_vector(spark):
    rows = vectors(400)
    rows += [(1000 + i, rows[0][1]) for i in range(200)]
    got, want = found(ann.nearest(table(spark, rows), F.col("vec_id") % 20 == 0)), brute(rows)
    assert recall(got, want) >= 0.95
    for q in (0, 1000, 1180):  # copies of their own vector, the smallest ids first
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and sum(i >= 1000 for i, _ in got[q]) > 10


def test_small_tables_are_exact(spark):
    for n in (1, 2, 5, 21, 60):
        rows = [(i * 20, v) for i, v in vectors(n, 3, seed=n)]
        want = {q: near for q, near in brute(rows).items() if near}
        got = found(ann.nearest(table(spark, rows), F.col("vec_id") % 20 == 0))
        assert {q: [i for i, _ in near] for q, near in got.items()} == {q: [i for i, _ in near] for q, near in want.items()}


def test_rows_that_take_no_part(spark):
    good = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.0, 2.0]), (4, [-1.0, 0.0])]
    bad = [(40, None), (60, [0.0, 0.0]), (80, [float("nan"), 1.0]), (100, [float("inf"), 1.0]), (120, [None, 1.0]), (140, [1.0]), (160, []), (None, [9.0, 9.0]), (180, [1.0, 2.0, 3.0])]
    got = found(ann.nearest(table(spark, good + bad), F.col("vec_id") % 20 == 0))
    assert got == {0: [(20, 0.5), (3, 0.0), (4, -1.0)], 20: [(3, 1.0), (0, 0.5), (4, -0.5)]}
    assert ann.nearest(table(spark, good).where("false")).count() == 0
    assert ann.nearest(table(spark, bad[:5])).count() == 0


def test_rows_that_repeat_an_id_are_one(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 1.0]), (1, [0.25, 1.0]), (2, [0.1, 1.0])]
    got = found(ann.nearest(table(spark, rows), F.col("vec_id") == 0))
    assert [i for i, _ in got[0]] == [1, 2] and got[0][0][1] in (0.5, 0.25)


def test_ties_go_to_the_smaller_id(spark):
    rows = [(0, [1.0, 0.0])] + [(i, [0.5, float(i % 7)]) for i in range(1, 60)]
    got = found(ann.nearest(table(spark, rows), F.col("vec_id") == 0))
    assert [i for i, _ in got[0]] == list(range(1, 21))


def test_pruned_edges_are_those_of_the_definition():
    rng = np.random.default_rng(4)
    x = ann.unit_space(rng.normal(size=(40, 6)))
    candidates = np.array([rng.permutation(np.arange(1, 40))])
    sims = (x[candidates[0]] @ x[0])[None]
    got = [int(i) for i in ann.robust_prune(x, candidates, sims, 8, 1.2)[0] if i >= 0]
    left, want = sorted(range(1, 40), key=lambda i: -float(x[i] @ x[0])), []
    while left and len(want) < 8:
        best = left.pop(0)
        want.append(best)
        left = [i for i in left if 1.2 * (1 - float(x[best] @ x[i])) > 1 - float(x[0] @ x[i])]
    assert got == want


def test_beams_grow_with_their_shard_and_shards_with_the_table():
    assert [ann.beam_for(n) for n in (1, 4096, 16_384, 65_536)] == [96, 96, 192, 384]
    assert [ann.shard_count(n) for n in (0, 4096, 4097, 51_282, 524_289)] == [1, 1, 2, 8, 9]


def test_search_reaches_all_nodes_with_a_wide_beam():
    x = ann.unit_space(np.random.default_rng(2).normal(size=(500, 8)))
    graph = ann.build_graph(x)
    seen = np.zeros((ann.QUERIES, 500), bool)
    nodes, _ = ann.beam_search(x, graph, x[:3], 500, seen)
    assert all(len({int(i) for i in row if i >= 0}) >= 490 for row in nodes) and not seen.any()
    assert (graph != np.arange(500)[:, None]).all()
