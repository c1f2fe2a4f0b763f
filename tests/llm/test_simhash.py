import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
import xxhash

from gatedframe.llm import neardup, simhash


def brute_fingerprint(text, width=4):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(fps))]


def test_fingerprint_is_that_of_the_definition():
    rng = random.Random(1)
    texts = ["", " \t", "a", "A b C", "one two three four", "É é  x y z w"]
    texts += [" ".join(rng.choice("ab cd efg Hij k".split()) for _ in range(rng.randrange(1, 90))) for _ in range(40)]
    for t in texts:
        assert int.from_bytes(simhash.fingerprint(t.encode()), "big") == brute_fingerprint(t)


def test_apart_is_the_manhattan_distance():
    rng = np.random.default_rng(2)
    x, y = (rng.integers(0, 2**64, 500, dtype=np.uint64) for _ in range(2))
    lanes = lambda v: np.array([[int(a) >> 2 * k & 3 for k in range(32)] for a in simhash._lanes(v)])
    expected = np.abs(lanes(x) - lanes(y)).sum(axis=1)
    assert (simhash._apart(simhash._lanes(x), simhash._lanes(y)) == expected).all()
    assert (expected <= np.bitwise_count(x ^ y)).all()


def flipped(rng, fp, n):
    for bit in rng.sample(range(64), n):
        fp ^= 1 << bit
    return fp


def signed(fp):
    return fp - (1 << 64) if fp >> 63 else fp


def components_of(spark, fps):
    from gatedframe.llm.components import connected_components
    from gatedframe.llm.storage import Scratch

    nodes = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = {r.node: r.root for r in connected_components(simhash.link_edges(nodes), Scratch(spark, "t")).collect()}
    return [got.get(signed(f), signed(f)) for f in fps]


def same_classes(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_links_are_those_of_all_pairs(spark, monkeypatch):
    rng = random.Random(3)
    fps = set()
    for _ in range(60):
        seed = rng.getrandbits(64)
        fps |= {seed} | {flipped(rng, seed, n) for n in (1, 2, 3, 4, 5, 6)}
    fps = sorted(fps | {0, (1 << 64) - 1, 1 << 63})
    assert same_classes(brute_components(fps), components_of(spark, fps))


def test_dense_groups_and_chains(spark, monkeypatch):
    rng = random.Random(4)
    seed = rng.getrandbits(64)
    fps = {flipped(rng, seed, rng.randrange(0, 4)) for _ in range(300)}
    chain = rng.getrandbits(64)
    for n in range(14):
        fps.add(chain ^ ((1 << 4 * n) - 1))
    fps = sorted(fps)
    monkeypatch.setattr(simhash, "CHUNK", 20)
    assert same_classes(brute_components(fps), components_of(spark, fps))


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_rows_nulls_ties_and_extra_columns(spark):
    rows = [(5, None), (4, ""), (9, " \n "), (3, "a b c d e"), (2, "A B C D E"), (2, "A B C D E"), (None, "a b c d e"), (7, "unlike any other text at all")]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, fp string, u string")
    got = sorted((r.doc_id is None, r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(docs).collect())
    expected = sorted((i is None, i, f"{brute_fingerprint(t):016x}", c) for (i, t), c in zip(rows, [4, 4, 4, 2, 2, 2, 2, 7]))
    assert got == expected
    kept = simhash.keep_one_per_component(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 7]
    only_null = spark.createDataFrame([(None, "p q r s t", "", ""), (None, "p q r s t", "", ""), (None, "1 2 3 4 5 6", "", "")], docs.schema)
    assert simhash.keep_one_per_component(only_null).count() == 2


LETTERS = ["the quick brown fox jumps over a lazy dog", "pack my box with five dozen liquor jugs", "sphinx of black quartz judge my vow today", "how vexingly quick daft zebras jump again"]


def brute_kept(rows, linked):
    """Rows kept of (id, text, ...): per component of ``linked`` texts the one with the least (id null, id); rows of equal id and text are one."""
    groups = []
    for r in rows:
        met = [g for g in groups if any(linked(r[1], x[1]) for x in g)]
        groups = [g for g in groups if g not in met] + [[r, *(x for g in met for x in g)]]
    return sorted((min((r[0] is None, r[0] or 0) for r in g), len(g)) for g in groups)


@pytest.mark.parametrize("operator", ["simhash", "neardup"])
def test_one_row_of_each_component_where_ids_repeat(spark, operator):
    keep = {"simhash": simhash, "neardup": neardup}[operator].keep_one_per_component
    a, b, c, d = LETTERS
    rows = [(1, b), (2, a), (2, b), (3, c), (3, d), (None, a), (None, "only here and nowhere else at all"), (None, None), (4, ""), (4, " \t"), (3, c), (5, c)]
    rng = random.Random(9)
    made = [(i, t, 777 + k, "nth", k % 2, "row") for k, (i, t) in enumerate(rows)]
    rng.shuffle(made)
    docs = spark.createDataFrame(made, "doc_id long, text string, _key long, nth string, last int, row string").repartition(3)
    kept = keep(docs)
    assert kept.columns == docs.columns
    got = [tuple(r) for r in kept.collect()]
    assert set(got) <= set(made) and len(set(got)) == len(got)
    texts = sorted(((r[0] is None, r[0] or 0), " ".join((r[1] or "").split())) for r in got)
    assert texts == sorted([((False, 1), b), ((False, 2), a), ((False, 3), c), ((False, 3), d), ((False, 4), ""), ((True, 0), "only here and nowhere else at all")])
    assert sorted(k for k, _ in brute_kept(made, lambda x, y: (x or "").split() == (y or "").split())) == [k for k, _ in texts]
    alike = spark.createDataFrame([(7, a)] * 50 + [(None, b)] * 50, "doc_id long, text string")
    assert sorted(r.text for r in keep(alike).collect()) == sorted([a, b])
    assert keep(docs.limit(0)).count() == 0


def test_a_cell_that_holds_half_of_the_fingerprints(spark, monkeypatch):
    rng = random.Random(12)
    seed = rng.getrandbits(64)
    near = {seed ^ (1 << a) ^ (1 << b) for a in range(0, 32) for b in range(32, 64, 3)}
    fps = sorted(near | {rng.getrandbits(64) for _ in range(len(near))})
    monkeypatch.setattr(simhash, "CHUNK", 64)
    met, whole = [], simhash.across
    monkeypatch.setattr(simhash, "across", lambda *a: met.append(whole(*a)) or met[-1])
    assert same_classes(brute_components(fps), components_of(spark, fps))
    members = {b: n for b, n in met[0].groupBy("bucket").agg(F.count_distinct("node")).collect()}
    assert met[0].count() <= 4 * sum(members.values())  # not each chunk with each


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert simhash.simhash_components(empty).count() == 0
    assert simhash.keep_one_per_component(empty).count() == 0


def test_very_long_text(spark):
    text = " ".join(f"w{i * i % 997}" for i in range(150_000))
    docs = spark.createDataFrame([(1, text), (2, text + " end")], "doc_id long, text string")
    got = simhash.simhash_components(docs).collect()
    assert {r.component_id for r in got} == {1}
    assert {r.doc_id: r.fingerprint for r in got}[1] == f"{brute_fingerprint(text):016x}"
