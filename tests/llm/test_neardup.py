import random

import pytest

from gatedframe.llm import neardup


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_kept(rows):
    """Smallest id of each component of all pairs with similarity >= 0.8, and how many pairs are not exact copies."""
    sets, parent, near = [shingles(t) for _, t in rows], list(range(len(rows))), 0

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or (both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both)):
                near += sets[a] != sets[b]
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted(least.values()), near


def planted():
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(5000)}"
    rows, i = [(0, None), (1, ""), (2, "a b"), (3, "A  b"), (4, "a b c d e")], 5
    for _ in range(60):
        base = [word() for _ in range(rng.randrange(60, 300))]
        for edits in range(5):
            words = list(base)
            for _ in range(edits * len(base) // 160 + (edits > 0)):
                words[rng.randrange(len(words))] = word()
            rows.append((i, " ".join(words)))
            i += 1
    base = [word() for _ in range(200)]
    for _ in range(40):  # many copies of one text, alike to it but hardly to each other
        words = list(base)
        for _ in range(4):
            words[rng.randrange(200)] = word()
        rows.append((i, " ".join(words)))
        i += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk", [neardup.CHUNK, 7])
def test_stage_keeps_one_of_each_group_of_near_copies(spark, monkeypatch, chunk):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    monkeypatch.setattr(neardup, "CHUNK", chunk)
    rows = planted()
    want, near = brute_kept(rows)
    assert near > 150  # and not exact copies
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()) == want
    assert neardup.keep_one_per_component(docs.limit(0)).count() == 0


def test_large_buckets_of_several_components(spark, monkeypatch):
    """A passage that fills most of every text puts texts of many components into the same buckets, one of them large."""
    monkeypatch.setattr(neardup, "CHUNK", 8)
    rng = random.Random(17)
    word = lambda: f"v{rng.randrange(9000)}"
    common, rows = [word() for _ in range(120)], []
    for group in range(12):
        own = [word() for _ in range(rng.choice([30, 36, 45]))]
        for _ in range(60 if group == 0 else 3):
            words = common + own
            words[rng.randrange(120, len(words))] = word()
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    across = []
    whole = neardup.across
    monkeypatch.setattr(neardup, "across", lambda *a: across.append(whole(*a)) or across[-1])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want, _ = brute_kept(rows)
    assert sorted(r.doc_id for r in neardup.keep_one_per_component(docs).collect()) == want and 1 < len(want) < 40
    assert len(across) == 1
