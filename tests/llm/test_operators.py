"""The other operators against brute force, over rows with nulls, ties, repeats, empty and very long texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from test_neardup import brute_kept

from gatedframe.llm import fingerprints, licenses, lm, mixing, packing, quality, queries, sharding, survivors, tokens, warc
from gatedframe.llm.storage import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, h string"
WORD = r"[^\x20\x09-\x0D]+"


def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)] + ["Été", "naïve", "<|endoftext|>", "$$$", "don't"]
    out = [None, "", "  \n\t", "one", "A b\nA b\n\nA b", "a a a a a", "x y z x y z q"]
    out += [" ".join(rng.choice(words) + rng.choice(["", ".", "\n"]) for _ in range(rng.randrange(1, 200))) for _ in range(50)]
    out += [out[20]] * 12 + [" ".join(rng.choice(words) for _ in range(6000))]
    return out


@pytest.fixture(scope="module")
def rows():
    found = [(i, t, "en", [None, "b", "a", "Z", "é"][i % 5], len(t or "")) for i, t in enumerate(texts())]
    return found + [(7, "again the same id", "en", "b", 17), (None, "no id at all", "en", None, 12)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df):
    return [tuple(r) for r in df.collect()]


def test_source_targets_fill_up(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, None: 300}
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    weight, fixed = {"a": 5, "b": 2, "c": 1, None: 5}, {}
    while True:  # share, fix those above their limit, share again
        rest = sum(sizes.values()) - sum(fixed.values())
        shares = {s: rest * weight[s] / sum(w for t, w in weight.items() if t not in fixed) for s in sizes if s not in fixed}
        above = [s for s, v in shares.items() if v > 3 * sizes[s]]
        if not above:
            break
        fixed |= {s: 3 * sizes[s] for s in above}
    assert got == pytest.approx(fixed | shares)


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 100):
        got = [r.p for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("p")).collect()]
        assert sorted(got) == list(range(n)) and (n < 100 or sum(a + 1 == b for a, b in zip(got, got[1:])) < 10)


def test_mixing(spark, docs, rows, empty):
    plan = mixing.mix_plan(docs, block=4)
    got = plan.collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=str) == sorted(collected(mixing.mix_plan(docs.repartition(2), block=4)), key=str)
    assert sorted(Counter(r.size for r in got).items()) == sorted(Counter(len(re.findall(WORD, t or "")) for _, t, *_ in rows).items())
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    by_source = {}
    for r in got:
        total = by_source.setdefault((r.source_size, r.target), [0])
        total[0] += r.taken
    assert all(abs(taken[0] - target) <= 0.05 * target + 8 for (_, target), taken in by_source.items())
    mixed = mixing.mix_documents(docs, block=4)
    assert mixed.columns == docs.columns
    assert sorted(len(re.findall(WORD, r.text)) for r in mixed.collect()) == sorted(r.taken for r in got if r.taken)
    assert mixing.mix_plan(empty).count() == 0 and mixing.mix_documents(empty).count() == 0


def test_mixing_numbers_chunks_of_shards_without_a_gap(docs, monkeypatch):
    whole = mixing.draw_counts
    monkeypatch.setattr(mixing, "draw_counts", lambda sources, slots: whole(sources, slots, 16))
    plan = lambda: sorted(collected(mixing.mix_plan(docs, block=4)), key=str)
    at_once = plan()
    monkeypatch.setattr(mixing, "CHUNK_SHARDS", 3)
    assert plan() == at_once


@pytest.mark.parametrize("unfolded", [7, 100_000])
def test_mixing_where_half_of_all_rows_are_alike(spark, monkeypatch, unfolded):
    monkeypatch.setattr(mixing, "UNFOLDED", unfolded)
    made = [(5, "the same words again and again", "a")] * 600 + [(1000 + i, f"words of {i} " * (i % 9), ["a", "b", None][i % 3]) for i in range(600)] + [(6, "", "b")] * 50
    docs = spark.createDataFrame(made, "doc_id long, text string, source string").repartition(4)
    got = mixing.mix_plan(docs).collect()
    assert sorted((r.doc_id, r["size"]) for r in got) == sorted((i, len(t.split())) for i, t, _ in made)
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        key = r.source_size
        size[key], taken[key], target[key] = size[key] + r["size"], taken[key] + r.taken, r.target
        assert r.taken <= 3 * r["size"]
    assert all(size[k] == k and abs(taken[k] - target[k]) <= 64 + 64 * k / 8192 for k in size)
    assert sum(len(r.text.split()) for r in mixing.mix_documents(docs).collect()) == sum(taken.values())


def test_hot_keys_are_cut_down_before_they_meet(docs):
    """One row of each key is chosen by a window whose limit already holds in the tasks that read the rows."""
    plan = survivors.kept(docs, survivors.keyed(docs, "doc_id", "text").select("key"), "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "Partial" in plan
    plan = mixing.mix_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "Partial" in plan


def test_mixing_gives_small_sources_their_target_over_hundreds_of_shards(spark, monkeypatch):
    whole, shards = mixing.draw_counts, []
    monkeypatch.setattr(mixing, "draw_counts", lambda sources, slots: shards.append(-(-slots // 16)) or whole(sources, slots, 16))
    words = {"a": 4, "b": 40, "c": 16_001, "d": 37}
    made = [(k, s, "w " * n) for k, (s, n) in enumerate(words.items())]
    for r in mixing.mix_plan(spark.createDataFrame(made, "doc_id long, source string, text string"), block=4).collect():
        assert abs(r.taken - r.target) <= 4 and r.taken <= 3 * r.size
    assert shards[0] > 200


def test_mixing_draws_counts_from_the_multinomial_given_totals(spark):
    totals = {0: 3, 1: 0, 2: 900, 3: 2098}
    slots = sum(totals.values())
    sources = spark.createDataFrame(list(totals.items()), "rank int, total long")
    counts = mixing.draw_counts(sources, slots, 16).collect()
    filled, got = Counter(), Counter()
    for r in counts:
        filled[r.shard] += r.n
        got[r["rank"]] += r.n
    assert all(filled[s] == (16 if s < 187 else 9) for s in range(188)) and dict(got) == {k: n for k, n in totals.items() if n}
    drawn = np.array([sum(r.n for r in counts if r["rank"] == 2 and r.shard == s) for s in range(187)])
    share = 900 / slots  # as many as a multinomial draw varies
    assert 0.7 < drawn.var() / (16 * share * (1 - share)) < 1.4 and drawn.min() < 4 and drawn.max() > 6
    many = spark.range(5000).selectExpr("cast(id as int) AS rank", "1L AS total")  # no sources times shards
    assert mixing.draw_counts(many, 5000, 16).count() <= 5000


def test_token_counts(spark, docs, rows, empty, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer())
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    want = sorted(((i is None, i, len((t or "").encode()), count(t), count(t) > 2048) for i, t, *_ in rows), key=str)
    cache = str(tmp_path / "cache")
    for _ in range(2):  # the second time every count is stored
        got = tokens.token_counts(docs, queries.tokenizer(), cache)
        assert sorted(((r.doc_id is None, *r) for r in got.collect()), key=str) == want
    assert spark.read.parquet(cache).count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, *_ in rows})
    assert tokens.token_counts(empty, queries.tokenizer()).count() == 0


@pytest.mark.parametrize("few", [100_000, 0])
def test_token_counts_encode_misses_alone(spark, docs, monkeypatch, tmp_path, few):
    monkeypatch.setattr(tokens, "FEW_MISSES", few)
    encoded, whole = [], tokens._encoded
    monkeypatch.setattr(tokens, "_encoded", lambda texts, path: encoded.append(texts.count()) or whole(texts, path))
    cache, half = str(tmp_path / "cache"), docs.where("doc_id % 2 = 0")
    distinct = lambda df: df.select(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")).distinct().count()
    tokens.token_counts(half, queries.tokenizer(), cache)
    want = sorted(collected(tokens.token_counts(docs, queries.tokenizer())), key=str)
    encoded[1:] = []
    for _ in range(2):
        assert sorted(collected(tokens.token_counts(docs, queries.tokenizer(), cache)), key=str) == want
    assert encoded == [distinct(half), distinct(docs) - distinct(half)]
    hot = spark.range(600).selectExpr("id AS doc_id", "IF(id % 2 = 0, 'one very common text', concat('text ', id)) AS text")
    assert tokens.token_counts(hot, queries.tokenizer(), cache).where("doc_id % 2 = 0").select("n_tokens").distinct().count() == 1


def test_fingerprints(docs, rows, empty):
    got = {}
    for r in fingerprints.fingerprint_documents(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    ids = sorted((i for i in got if i is not None), reverse=True)
    text = {i: t or "" for i, t, *_ in rows}
    for a, b in zip(ids, [*ids[1:], None]):
        if 7 in (a, b):
            continue
        t, n = text[a], text[b]
        h = len(t) // 2
        assert got[a][0].edited_sha256 == hashlib.sha256((t[: len(t) - h] + n[:h]).encode()).hexdigest() and got[a][0].n_chars == len(t)
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(WORD, t.lower())] for i in range(max(1, len(w) - 4))}
    errors = [got[a][0].near_next - len(shingles(text[a]) & shingles(text[b])) / len(shingles(text[a]) | shingles(text[b])) for a, b in zip(ids, ids[1:]) if 7 not in (a, b) and text[a].split() and text[b].split()]
    assert np.abs(errors).max() < 0.15
    same = {i: r[0].fingerprint for i, r in got.items() if text.get(i) == texts()[20]}
    assert len(same) == 13 and len(set(same.values())) == 1
    assert got[1][0].near_next == 1.0 and fingerprints.fingerprint_documents(empty).count() == 0


def test_fingerprint_neighbours_across_slices(docs, monkeypatch):
    want = sorted(collected(fingerprints.fingerprint_documents(docs)), key=str)
    monkeypatch.setattr(fingerprints, "SLICE_ROWS", 5)
    assert sorted(collected(fingerprints.fingerprint_documents(docs)), key=str) == want


def test_fingerprint_neighbours_where_one_id_fills_half_of_the_table(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "SLICE_ROWS", 10)
    made = spark.range(400).selectExpr("IF(id < 130, null, IF(id < 260, 7, id)) AS doc_id", "concat('t', id) AS text").repartition(4)
    keyed = made.withColumn("_key", F.coalesce("doc_id", F.lit(fingerprints.LEAST))).withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
    slices = keyed.groupBy(fingerprints._slice(fingerprints._bounds(keyed, 40)).alias("s")).count().collect()
    assert len(slices) > 30 and max(r["count"] for r in slices) < 40
    got = {r.text: (r.doc_id, r.next_text, r.next_doc_id) for r in fingerprints.with_next(made, "doc_id", ["text", "doc_id"]).collect()}
    at, seen = "t399", []
    for _ in range(400):  # one ring through all rows, by descending id
        seen.append(got[at][0])
        at = got[at][1]
    assert at == "t399" and seen == sorted((i for i in seen if i is not None), reverse=True) + [None] * 130


def brute_signature(hashes):
    """One-permutation MinHash of shingle hashes by the definition."""
    least = {}
    for h in hashes:
        b = (h >> 57) + 64
        least[b] = min(h, least.get(b, h))
    rng = random.Random(17)
    tables = [[rng.randrange(128) for _ in range(128)] for _ in range(fingerprints.PROBES)]
    borrowed = [next((least[t[b]] for t in tables if t[b] in least), None) for b in range(128)]
    return least, [least.get(b, borrowed[b]) for b in range(128)]


def test_signature_is_that_of_the_definition(spark):
    rng = random.Random(21)
    made = [(k, " ".join(f"w{rng.randrange(9000)}" for _ in range(n))) for k, n in enumerate([1, 4, 5, 6, 30, 120, 400, 3000])]
    df = spark.createDataFrame(made, "doc_id long, text string")
    got = {r.doc_id: r.sig for r in fingerprints.with_signature(df, "text", "sig").collect()}
    hashed = lambda words: [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).collect()]
    for k, text in made:
        codes = hashed(text.split())
        cut = [codes[i : i + 5] for i in range(max(1, len(codes) - 4))]
        if len(codes) >= 5:
            shingles = [r[0] for r in spark.createDataFrame(cut, "a long, b long, c long, d long, e long").select(F.xxhash64("a", "b", "c", "d", "e")).collect()]
        else:
            shingles = [r[0] for r in spark.createDataFrame([(codes,)], "a array<long>").select(F.xxhash64("a")).collect()]
        least, filled = brute_signature(shingles)
        for b in range(128):
            assert got[k][b] == (filled[b] & 255) - 128 if filled[b] is not None else got[k][b] in {(h & 255) - 128 for h in least.values()}


def test_sharding(spark, docs, rows, empty, tmp_path):
    got = sharding.shard_documents(docs, 4).collect()
    assert sorted((r["size"], r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t, *_ in rows)
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    even = spark.range(4000).selectExpr("id AS doc_id", "IF(id < 1500, repeat('a', 200), concat(repeat('b', 180), id)) AS text")
    sizes = Counter()
    for r in sharding.shard_documents(even, 8).collect():
        sizes[r.shard] += r["size"]
    assert max(sizes.values()) < 1.02 * min(sizes.values())
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)
    assert sharding.shard_documents(empty, 4).count() == 0
    clash = docs.withColumns({"Shard": F.lit(7), "size": F.lit("s"), "r": F.lit(None).cast("int"), "_id": F.lit(1)})
    sharding.write_shards(clash, str(tmp_path / "clash"), 4)
    back = spark.read.parquet(str(tmp_path / "clash"))
    assert back.columns == [*clash.columns, "shard_"] and sorted(map(str, back.drop("shard_").collect())) == sorted(map(str, clash.collect()))
    sharding.write_shards(empty, str(tmp_path / "empty"), 4)


@pytest.mark.parametrize("numbered", [100_000, 150])
def test_slots_keep_equal_texts_together(spark, monkeypatch, numbered):
    monkeypatch.setattr(sharding, "NUMBERED", numbered)
    made = spark.range(3000).selectExpr("id AS doc_id", "IF(id < 1200, 'the same', concat('text ', id div 3)) AS text").repartition(5)
    got = sharding.shard_documents(made, 7).collect()
    where = {}
    for r in got:
        where.setdefault((r.shard, r.text_crc32), []).append(r.slot)
    for s in range(7):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(max(slots) - min(slots) + 1 == len(slots) for slots in where.values())  # without a gap
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r["size"]
    assert max(sizes.values()) < 1.05 * min(sizes.values())


def test_equal_texts_share_a_shard(spark):
    """No group that fits a shard is cut, over all documents of sf0.1; shards stay as near as the largest row or group at a boundary lets them."""
    found = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = sharding.shard_documents(found).join(found.select("doc_id", F.sha2("text", 256).alias("text")), "doc_id").collect()
    shards, sizes = {}, Counter()
    for r in got:
        shards.setdefault(r.text, Counter())[r.shard] += r["size"]
        sizes[r.shard] += r["size"]
    mean = sum(sizes.values()) / 40
    assert len(sizes) == 40 and len(got) == found.count()
    assert all(len(s) == 1 for s in shards.values() if sum(s.values()) <= mean)
    largest = max(sum(s.values()) for s in shards.values())
    assert max(abs(s - mean) for s in sizes.values()) <= largest + 0.01 * mean


def test_a_group_larger_than_a_shard_is_cut_and_a_smaller_one_is_not(spark):
    made = spark.range(4000).selectExpr("id AS doc_id", "CASE WHEN id < 1500 THEN repeat('a', 200) WHEN id < 1800 THEN repeat('c', 200) ELSE concat(repeat('b', 180), id) END AS text")
    got, where = sharding.shard_documents(made, 8).collect(), {}
    for r in got:
        where.setdefault(r.text_crc32, set()).add(r.shard)
    assert sorted(map(len, where.values()))[-2:] in ([1, 3], [1, 4]) and {r.shard for r in got} == set(range(8))


def test_splitters_are_those_of_a_sort(spark):
    rng = random.Random(4)
    made = [(rng.choice([5, 5, 5, rng.randrange(-(1 << 63), 1 << 63)]), rng.randrange(-(1 << 63), 1 << 63), rng.randrange(1, 300)) for _ in range(2000)]
    keys = spark.createDataFrame(made, "h long, r long, size long")
    total, splitters = sum(m[2] for m in made), sharding.find_splitters(keys, 9, 0.005)
    for j, (h, r) in enumerate(splitters, 1):
        below = sum(size for a, b, size in made if (a, b) < (h, r))
        assert abs(below - total * j / 9) <= max(0.005 * total / 9, 300)


def test_warc(spark, tmp_path):
    long = "<p>é WARC/1.1\r\nWARC/1.0 " + "x" * 200
    pages = [(5, "http://a/", long), (2, "http://b/", long), (9, None, long), (1, "u", "short"), (3, "u", "short"), (4, "u", None), (6, "v", "<b>\n\r\n\r\n" + "y" * 300), (2, "http://b/", long), (None, "w", "z" * 150), (8, "w", "z" * 150), (10, "big", "q" * 3_000_000)]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, row string").repartition(3)
    payload = lambda t: (t or "").encode()
    got = warc.round_trip(df).collect()
    assert sorted((r.page_id or 0, r.payload_bytes, r.payload_digest) for r in got) == sorted((i or 0, len(payload(t)), hashlib.sha256(payload(t)).hexdigest()) for i, _, t in pages)
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in got)
    assert kinds == [(0, "revisit", 8), (1, "response", 0), (2, "response", 0), (2, "revisit", 2), (3, "response", 0), (4, "response", 0), (5, "revisit", 2), (6, "response", 0), (8, "response", 0), (9, "revisit", 2), (10, "response", 0)]
    path = str(tmp_path / "w")
    warc.write_archives(warc.plan_records(df, Scratch(spark, "t")), path)
    whole = warc.assemble(warc.read_records(spark, path)).collect()
    assert len(whole) == len(pages) and all(r.request.kind == "request" and r.metadata.kind == "metadata" for r in whole)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_mark_at_every_place(spark):
    mark = "WARC/1."
    inside = [mark, f"{mark}1", f"{mark}0\r\n", f"{mark}1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", f"x{mark * 5}", f"\r\n\r\n{mark}"]
    pages = [(k, f"http://h/{u}/{k}", p + ("z" * 200) * (k % 2)) for k, (u, p) in enumerate((u, p) for u in ["", *inside] for p in ["", *inside])]
    pages += [(1000 + i, u, p) for i, u, p in pages[:20]]
    got = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()}
    assert len(got) == len(pages)
    first = {}
    for i, _, p in pages:
        first[p] = min(i, first.get(p, i))
    for i, _, p in pages:
        revisit = len(p.encode()) >= 100 and first[p] != i
        assert tuple(got[i]) == (i, len(p.encode()), hashlib.sha256(p.encode()).hexdigest(), "revisit" if revisit else "response", first[p] if revisit else None)


def test_warc_reads_cut_and_foreign_archives(spark, tmp_path):
    record = lambda k, body: f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <{k}>\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"
    for name, content in (("a", record("1", "one") + record("2", "WARC/1.0\r\nin it")), ("b", record("3", "three")[:-7]), ("c", "WARC/1.0\r\nWARC-Ty"), ("d", record("4", "")), ("e", "")):
        (tmp_path / name).write_bytes(content.encode())
    got = {r.record_id: bytes(r.payload) for r in warc.read_records(spark, str(tmp_path)).collect()}
    assert got == {"<1>": b"one", "<2>": b"WARC/1.0\r\nin it", "<3>": b"th", "<4>": b""}


def test_warc_one_payload_holds_half_of_the_pages(spark):
    pages = [(k, "http://a/", "same " * 40 if k % 2 else f"page {k} " * 20) for k in range(400)]
    got = warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)).collect()
    assert sorted(r.page_id for r in got if r.record_type == "revisit") == list(range(3, 400, 2)) and {r.refers_to for r in got} == {None, 1}


def test_first_fit_decreasing():
    rng = random.Random(6)
    sizes = np.array([rng.randrange(1, 100) for _ in range(300)])
    free, want = [], {}
    for k in sorted(range(300), key=lambda k: -sizes[k]):
        at = next((b for b, f in enumerate(free) if f >= sizes[k]), len(free))
        free += [128] * (at == len(free))
        want[k] = (at, 128 - free[at])
        free[at] -= sizes[k]
    bins, offsets = packing.first_fit_decreasing(sizes, 128)
    assert {k: (bins[k], offsets[k]) for k in range(300)} == want


def test_packing(docs, rows, empty):
    got = packing.pack_documents(docs, queries.tokenizer(), group_docs=20).collect()
    library = Tokenizer.from_file(queries.tokenizer())
    encode = lambda texts: [np.array(library.encode(t.decode(), add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    want = Counter()
    for i, t, *_ in rows:
        ids = encode([(t or "").encode()])[0] + np.array([1], "<u4").tobytes()
        want[i, len(ids) // 4] += len(ids) // 4
    have = Counter()
    for r in got:
        have[r.doc_id, r.doc_tokens] += r.length
    assert have == want
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) <= 2048
    assert packing.pack_documents(empty, queries.tokenizer()).count() == 0
    packed = docs.sparkSession.createDataFrame(got)
    made = Counter(bytes(np.array(r.ids, "<u4").tobytes()) for r in packing.sequences(docs, packed, queries.tokenizer()).collect())
    texts = {}
    for i, t, *_ in rows:
        ids = encode([(t or "").encode()])[0] + np.array([1], "<u4").tobytes()
        for at in range(0, len(ids), 8192):
            texts[i, at // 4, zlib.crc32(ids[at : at + 8192])] = ids[at : at + 8192]
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, texts[r.doc_id, r.start, r.ids_crc32]))
    assert made == Counter(b"".join(x for _, x in sorted(parts)) for parts in by_sequence.values())
    padding = 2048 * len(by_sequence) - sum(r.length for r in got)
    assert padding < 2048 * 4


def test_lm_scores(spark, docs, rows, empty):
    got = lm.lm_scores(docs).collect()
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    tokens_of = lambda t: [*re.findall(WORD, low(t)), ""]
    counts = Counter(w for i, t, *_ in rows if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2 for w in tokens_of(t))
    n, v = sum(counts.values()), len(counts)
    base = lambda t: sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens_of(t))
    want = sorted((len(tokens_of(t)), sum(w in counts for w in tokens_of(t)), round(base(t), 6)) for _, t, *_ in rows)
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want and {r.train_tokens for r in got} == {n}
    assert all(r.score < 0 for r in got) and lm.lm_scores(empty).count() == 0


def test_lm_counts_of_rare_words_are_joined(docs, monkeypatch):
    want = sorted((r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in lm.lm_scores(docs).collect())
    monkeypatch.setattr(lm, "FREQUENT", 10)
    assert sorted((r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in lm.lm_scores(docs).collect()) == want


def test_lm_frequent_words_are_bounded(spark):
    counts = spark.range(1, 3000).selectExpr("cast(concat('w', id) as binary) AS word", "3000 div id AS n")
    for most in (0, 1, 40, 700, 5000):
        found = [r.n for r in lm._frequent(counts, most).collect()]
        rest = [3000 // k for k in range(1, 3000) if 3000 // k not in set(found)]
        assert len(found) <= most and (not found or not rest or min(found) > max(rest)) and (most < 40 or len(found) > most // 3 or not rest)


def test_lm_bits_sum_to_one_and_context_helps(spark):
    rng = random.Random(8)
    follow = {f"a{i}": f"b{i}" for i in range(40)}
    made = [(i, " ".join(x for _ in range(60) for a in [f"a{rng.randrange(40)}"] for x in (a, follow[a]))) for i in range(120)]
    df = spark.createDataFrame(made, "doc_id long, text string")
    got = [r for r in lm.lm_scores(df).collect() if r.held_out]
    assert got and sum(r.score for r in got) > 0.8 * sum(r.base_score for r in got) and all(r.score > r.base_score for r in got)
    model, start, _ = lm.train(df, Scratch(spark, "t"))
    every = np.arange(1 << lm.BITS)
    codes = every.astype(np.uint64) << np.uint64(64 - lm.BITS)
    bits, first, second = lm._contexts(codes, every)
    nothing = (np.zeros(len(every), np.int64), np.zeros(len(every), bool))
    for expected in (nothing, (np.full(len(every), 77), np.ones(len(every), bool))):
        probabilities = lm.mixed_bits(model, start, (bits, first, second, *expected), every, np.ones(len(every), int))
        assert abs((10**probabilities).sum() - 1) < 1e-5


def test_lm_letters_are_a_code(spark):
    rng = random.Random(3)
    tables = lm.letter_tables([bytes(rng.choice(b"abcde") for _ in range(rng.randrange(1, 6))) for _ in range(500)])
    one = lm.spelled(tables, [bytes([x]) for x in range(256) if x != 32])
    ends = 10 ** lm.spelled(tables, [b""])[0]
    two = lm.spelled(tables, [b"a" + bytes([x]) for x in range(256) if x != 32])
    begins = lm.spelled(tables, [b"ax"])[0] - lm.spelled(tables, [b"ay"])[0]
    assert 0 < (10**one).sum() + ends < 1 and (10**two).sum() < 1 and begins < 0.7  # no more than all there is
    assert lm.spelled(tables, [b"q" * 10_000])[0] < 1000 * lm.spelled(tables, [b"a"])[0]
    assert lm.spelled(tables, [b"abc", b"", b"deb"]) == pytest.approx([lm.spelled(tables, [w])[0] for w in (b"abc", b"", b"deb")])
    made = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(80))) for i in range(60)]
    held = [i for i, _ in made if lm.is_held_out(i)]
    junk = {held[0]: "x" * 5000, held[1]: "x"}
    made = [(i, t + " " + junk[i] if i in junk else t) for i, t in made]
    got = {r.doc_id: r for r in lm.lm_scores(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert got[held[0]].spelled_score < got[held[1]].spelled_score - 2000 and got[held[0]].n_known == got[held[0]].n_tokens - 1
    assert got[held[0]].bits_per_byte > 1


def brute_scores(model, start, text):
    """log10 probability of a text, one decision after another."""
    words = [*text.encode().translate(lm.ASCII_LOWER).split(), b""]
    bits, first, second = lm._contexts(np.array([xxhash.xxh64_intdigest(w, 42) for w in words], np.uint64), np.array([0]))
    weights, refined, total, last = start.weights.astype(float), start.refined.astype(float), 0.0, {}
    for t, b in enumerate(bits.tolist()):
        slots = [s[:, 0] for s in lm._slots(bits[t : t + 1], first[t : t + 1], second[t : t + 1], model.width)]
        hoped = last.get(int(second[t]))
        last[int(second[t])] = b
        for k in range(lm.BITS):
            found = [int(model.table[s[k]]) for s in slots]
            agreed = hoped is not None and (hoped ^ b) >> (lm.BITS - k) == 0
            x = [f / 256 for f in (v >> 2 for v in found)] + [(2 * (hoped >> (lm.BITS - 1 - k) & 1) - 1) * lm.EXPECTED if agreed else 0.0]
            gate = (found[1] & 3) * 4 + (found[2] & 3) + 16 * agreed
            y = b >> (lm.BITS - 1 - k) & 1
            z = min(max(sum(w * v for w, v in zip(weights[gate], x)), -lm.LIMIT), lm.LIMIT)
            p = 1 / (1 + math.exp(-z))
            weights[gate] += lm.RATE * (y - p) * np.array(x)
            cell = int((z + 14) * lm.MAP_CELLS / 28)
            final = p + lm.MAP_SHARE * (refined[cell] - p)
            refined[cell] += lm.MAP_RATE * (y - refined[cell])
            total += math.log10(final if y else 1 - final)
    return total


def test_lm_learns_from_every_training_document(spark):
    """Tables, starting weights and letters, each against all training texts read at once."""
    rng = random.Random(31)
    made = [(i, " ".join(f"w{int(rng.paretovariate(0.8)) % 500}" for _ in range(rng.randrange(1, 300)))) for i in range(200)]
    model, start, _ = lm.train(spark.createDataFrame(made, "doc_id long, text string").repartition(5), Scratch(spark, "t"))
    texts = [t.encode() for i, t in made if not lm.is_held_out(i)]
    table = np.zeros(2 * lm._slot_count(model.width), np.int64)
    for t in texts:
        codes = np.array([xxhash.xxh64_intdigest(w, 42) for w in lm._tokens(t)], np.uint64)
        bits, first, second = lm._contexts(codes, np.array([0]))
        for slots in lm._slots(bits, first, second, model.width):
            np.add.at(table, (2 * slots + lm._answers(bits)).ravel(), 1)
    assert (lm._predictor(table) == model.table).all()
    sums = lm._no_sums()
    for t in texts:
        lm.read_sums(lm._without_one(table), model.width, [t], lm._Lexicon({}), sums)
    want = lm.mean_start(sums)
    assert np.allclose(start.weights, want.weights, atol=1e-5) and np.allclose(start.refined, want.refined, atol=1e-5) and not (start.weights == lm._hand_weights()).all()
    words = sorted({w for t in texts for w in t.split()})
    assert all((a == b).all() for a, b in zip(model.letters, lm.letter_tables(words)))


def test_lm_reads_a_counted_text_as_if_it_had_not_been_counted():
    counts = np.array([0, 1, 3, 0, 5, 2, 0, 0])
    rest = lm._without_one(counts)
    for slot, (n0, n1) in enumerate(counts.reshape(-1, 2)):
        assert rest[2 * slot] == lm._predictor(np.array([max(n0 - 1, 0), n1]))[0] and rest[2 * slot + 1] == lm._predictor(np.array([n0, max(n1 - 1, 0)]))[0]



def test_lm_cuts_hashes_and_knows_words_without_python_objects(monkeypatch):
    rng = random.Random(5)
    texts = [b"", b" ", b"  Ab\x0b\x0cC\t\n", bytes(9), b"\x85\xa0 \x1c", *(b"x" * n + b" " + b"Y" * n for n in range(70))]
    texts += [bytes(rng.choice(b"aBc \n\x00\xff\t\x1f") for _ in range(rng.randrange(300))) for _ in range(200)]
    words = [w for t in texts for w in lm._tokens(t)]
    cut = lm._cut(texts)
    assert cut.sizes.tolist() == [len(lm._tokens(t)) for t in texts]
    assert cut.codes().tolist() == [xxhash.xxh64_intdigest(w, 42) for w in words]
    logs = {w: float(n) for n, w in enumerate(sorted(set(words))) if n % 2}
    want = np.array([logs.get(w, np.nan) for w in words])
    assert np.array_equal(lm._Lexicon(logs).known(cut, cut.codes()), want, equal_nan=True)
    hashes = lm._hashes
    monkeypatch.setattr(lm, "_hashes", lambda *a: hashes(*a) & np.uint64(255 << 40))  # different words share hashes
    few = dict([*logs.items()][::9])
    want = np.array([few.get(w, np.nan) for w in words])
    assert np.array_equal(lm._Lexicon(few).known(cut, cut.codes()), want, equal_nan=True)


def test_lm_equal_keys_stay_in_order():
    rng = np.random.default_rng(3)
    for low in (1, 2, 1000):  # keys that differ only in the bits that places are put in, too
        key = rng.integers(0, 40, 3000).astype(np.uint64) * np.uint64(1 << 58) + rng.integers(0, low, 3000).astype(np.uint64)
        assert (lm._stable_order(key) == np.argsort(key, kind="stable")).all()


def test_lm_letters_come_from_all_words(spark):
    counts = spark.range(120_000).selectExpr("cast(concat('w', id * 7919) as binary) AS word", "1L AS n").repartition(4)
    want = lm.letter_tables([f"w{i * 7919}".encode() for i in range(120_000)])
    assert all((a == b).all() for a, b in zip(lm._learn_letters(counts), want))


def test_lm_mixing_is_that_of_the_definition(spark):
    rng = random.Random(13)
    word = lambda: f"w{int(rng.paretovariate(0.8)) % 500}"
    made = [(i, " ".join(word() for _ in range(rng.randrange(1, 120)))) for i in range(400)]
    model, start, counts = lm.train(spark.createDataFrame(made, "doc_id long, text string"), Scratch(spark, "t"))
    assert not (start.weights == lm._hand_weights()).all()  # some were set apart to learn from
    counted = {bytes(r.word): r.n for r in counts.collect()}
    assert sum(counted.values()) == sum(len(t.split()) + 1 for i, t in made if not lm.is_held_out(i))
    got = {r.doc_id: r for r in lm.lm_scores(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    for i, t in [m for m in made if lm.is_held_out(m[0])][:12]:
        shares = letters = 0.0
        for w in [*t.encode().split(), b""]:
            same = [n for x, n in counted.items() if xxhash.xxh64_intdigest(x, 42) >> (64 - lm.BITS) == xxhash.xxh64_intdigest(w, 42) >> (64 - lm.BITS)]
            shares += math.log10((counted.get(w, 0) + 1) / (sum(same) + len(same) + 1))
            letters += 0 if w in counted else lm.spelled(model.letters, [w])[0]
        assert got[i].score == pytest.approx(brute_scores(model, start, t) + shares, abs=0.02) and got[i].spelled_score == pytest.approx(letters)
        assert got[i].bits_per_byte == pytest.approx(-(got[i].score + letters) / math.log10(2) / len(t.encode()))


def test_alignment_and_scan(spark, empty):
    words = lambda t: t.encode().split()
    assert licenses.align(words("a b c d e"), words("x a b q c y d e")) == [(0, 1), (1, 2), (2, 4), (3, 6), (4, 7)]
    assert licenses.align(words("a b a c"), words("a b a c a b a c"))[:4] == [(0, 0), (1, 1), (2, 2), (3, 3)]
    mit = licenses.TEMPLATES["MIT"][2]
    broken = mit.replace("free of charge", "at no cost").replace("publish, ", "")
    made = [(1, "Some words.\nReleased under the MIT License."), (2, "x " * 500 + mit.upper() + " y" * 500), (3, broken), (4, None), (5, "a licensed plumber"), (6, "Released under the MIT License. " * 300), (7, "Licensed under the Apache License, Version 2.0 and released under the MIT license")]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert [got[i].license for i in range(1, 8)] == ["MIT", "MIT", "MIT", None, None, "MIT", "Apache-2.0"]
    assert got[7].licenses == ["Apache-2.0", "MIT"] and (got[1].start_word, got[1].end_word) == (2, 7) and 0.9 < got[3].coverage < 1
    assert licenses.license_scan(empty).count() == 0


@pytest.mark.parametrize(
    "text, want",
    [
        ("Licensed under the BSD License", []),
        ("Licensed under the Apache License, Version 2.0", ["Apache-2.0"]),
        ("licensed under the GNU General Public License, version 3", ["GPL-3.0"]),
        ("licensed under the GNU General Public License, version 2", ["GPL-2.0"]),
        ("licensed under the GNU Lesser General Public License, version 3", ["LGPL-3.0"]),
        ("Licensed under CC BY-NC 4.0", ["CC-BY-NC-4.0"]),
        ("Licensed under CC BY-SA 4.0", ["CC-BY-SA-4.0"]),
        ("Licensed under CC BY 4.0", ["CC-BY-4.0"]),
        ("Licensed under CC BY 3.0", []),
        ("licensed under the MIT License or under the Apache License, Version 2.0", ["Apache-2.0", "MIT"]),
        (licenses.TEMPLATES["BSD-3-Clause"][0], ["BSD-3-Clause"]),
        (licenses.TEMPLATES["BSD-2-Clause"][0], ["BSD-2-Clause"]),
        (licenses.TEMPLATES["GPL-2.0"][1], ["GPL-2.0"]),
    ],
)
def test_a_notice_names_its_own_license_alone(text, want):
    for t in (text, "Some words before. " + text + ". And words behind it."):
        assert sorted(f[2] for f in licenses.scan(t.encode(), licenses._prepared())[1] if f[0] >= licenses.COVERAGE) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("Available under CC BY 4.0", ["CC-BY-4.0"]),
        ("This text is under CC BY-NC 4.0", ["CC-BY-NC-4.0"]),
        ("Released under the MIT Licence", ["MIT"]),
        ("Released under the terms of the well known MIT License", ["MIT"]),
    ],
)
def test_notices_without_a_word_of_licensing_or_with_an_insertion_are_found(text, want):
    assert [f[2] for f in licenses.scan(text.encode(), licenses._prepared())[1] if f[0] >= licenses.COVERAGE] == want


def brute_finds(text):
    """Names found where a template is laid beside the text with any of its words on any same word of the text."""
    words, best = licenses.WORD.findall(text.lower().encode()), {}
    for t in licenses._prepared():
        n = len(t.words)
        for at, word in enumerate(words):
            for place in [k for k, w in enumerate(t.words) if w == word]:
                for spare in (n // 4 + 1, n):
                    pairs = licenses._laid(t.words, words, at, place, spare)
                    marked = [b for a, b in pairs if t.words[a] in t.marks]
                    apart = set(words[marked[0] : marked[-1] + 1]) - t.marks if marked else set()
                    if t.marks <= {words[b] for b in marked} and not licenses.OTHERS & apart and 5 * len(pairs) >= 4 * n:
                        best[t.name] = max(best.get(t.name, 0), len(pairs))
    return best


def test_scan_finds_what_brute_force_finds():
    rng = random.Random(31)
    shorts = [(name, t) for name, texts in licenses.TEMPLATES.items() for t in texts if len(t.split()) < 60]
    filler, found = [f"w{k}" for k in range(40)] + ["the", "under", "license", "version", "cc", "software"], 0
    for k in range(150):
        name, t = rng.choice(shorts)
        words = t.split()
        for _ in range(rng.randrange(4)):  # dropped, exchanged and added words
            at, what = rng.randrange(len(words)), rng.randrange(3)
            words[at : at + (what < 2)] = [] if what == 0 else [rng.choice(filler)]
            words = words or ["x"]
        text = " ".join([rng.choice(filler) for _ in range(rng.randrange(30))] + words + [rng.choice(filler) for _ in range(rng.randrange(30))])
        want = brute_finds(text)
        got = {f[2]: f[1] for f in licenses.scan(text.encode(), licenses._prepared())[1] if f[0] >= licenses.COVERAGE}
        # of what covers the same words only the longer find stays
        longest = {n for n, c in want.items() if c == max(want.values())}
        assert set(got) <= set(want) and bool(got) == bool(want) and (not want or longest & set(got)), text
        found += name in got
    assert found > 70


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_whole_texts_name_their_own_license_alone(name):
    rng = random.Random(1)
    for text in licenses.TEMPLATES[name]:
        words = f"Copyright 2020 Somebody. {text} Yours, all of us".split()
        if len(words) > 60:  # one word in thirty misread
            for at in rng.sample(range(3, len(words) - 4), len(words) // 30):
                words[at] = words[at] if words[at].lower().strip(".,();") in {w.decode() for w in licenses.MARKS} or any(c.isdigit() for c in words[at]) else "misread"
        found = [f for f in licenses.scan(" ".join(words).upper().encode(), licenses._prepared())[1] if f[0] >= licenses.COVERAGE]
        assert [f[2] for f in found] == [name], (text, found)


def test_license_scan_of_rows(spark):
    mit = licenses.TEMPLATES["MIT"][3]
    made = [(None, mit), (None, None), (1, "word " * 300_000 + mit + " word" * 1000), (1, mit), (2, " ")]
    got = licenses.license_scan(spark.createDataFrame([(i, t, "x") for i, t in made], "doc_id long, text string, license string")).collect()
    assert sorted((r.doc_id or 0, r.license or "") for r in got) == [(0, ""), (0, "MIT"), (1, "MIT"), (1, "MIT"), (2, "")]


def brute_quality(t):
    t = t or ""
    w, seen, again = re.findall(WORD, t), set(), 0
    for line in t.split("\n"):
        if re.search(WORD, line):
            again += line in seen
            seen.add(line)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_grams_are_of_characters():
    for text in ("abcd", "été 𝄞x", "日本語の文", "ab", ""):
        c = [ord(x) for x in text]
        want = [(((a * 65599 + b) * 65599 + d) % 2**32 * 2654435761 % 2**32) >> 17 for a, b, d in zip(c, c[1:], c[2:])]
        assert quality._grams(text.encode()).tolist() == want


def test_quality_counts(docs, rows, empty):
    got = quality.quality_rules(docs, quality.ACCEPT_ALL).collect()
    assert sorted(tuple(r)[1:7] for r in got) == sorted(brute_quality(t) for _, t, *_ in rows)
    assert all(r.kept == (not r.base_failed) for r in got)
    kept = quality.keep_good(docs, quality.ACCEPT_ALL)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert quality.quality_rules(empty, quality.ACCEPT_ALL).count() == 0


def test_quality_classifier_on_held_out_rows(spark):
    docs, labels = queries.read(spark, "/root/testdata/sf0.01", "documents"), queries.read(spark, "/root/testdata/sf0.01", "labels")
    test = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = quality.train(docs, labels.where(~test))
    judged = quality.quality_rules(docs, model).join(labels.where(test).select("doc_id", F.col("quality").alias("label")), "doc_id").where("not base_failed").collect()
    assert sum(r.kept == bool(r.label) for r in judged) >= 0.97 * len(judged)
    assert not quality.train(docs, labels.where("quality = 5")).weights.any()


def test_pipeline_against_brute_force(spark):
    """Each stage on all that the one before kept, over documents of which some repeat an id, lack one or lack a text."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf, whole = "/root/testdata/sf0.001", queries.read(spark, "/root/testdata/sf0.001", "documents")
    first = [tuple(r) for r in whole.orderBy("doc_id").limit(40).collect()]
    odd = [(r[0] + 1, *r[1:]) for r in first[:20]] + [(None, *r[1:]) for r in first[20:30]] + [(r[0], (r[1] or "") + " one more word", *r[2:]) for r in first[30:]] + [(5, None, "en", None, 0)]
    docs = given_docs = whole.union(spark.createDataFrame(odd, whole.schema))
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        kept.append([tuple(r) for r in docs.collect()])
        if len(kept) < 4:
            assert docs.columns == whole.columns
    good, single, mixed, packed = kept
    model = quality.train(given_docs, queries.read(spark, sf, "labels"))
    given = [tuple(r) for r in whole.collect()] + odd
    judged = quality.measure([(r[1] or "").encode() for r in given], quality._Words(), model)[6]
    assert sorted(map(str, good)) == sorted(str(r) for r, ok in zip(given, judged) if ok)
    assert all(not brute_quality(r[1])[5] for r in good)
    want, _ = brute_kept([(1 << 60 if r[0] is None else r[0], r[1]) for r in good])
    assert sorted(1 << 60 if r[0] is None else r[0] for r in single) == want
    assert len({r[1] for r in single}) == len(single) and {str(r) for r in single} <= {str(r) for r in good}
    words = lambda t: re.findall(WORD, t or "")
    sizes, taken = Counter(), Counter()
    for r in single:
        sizes[r[3]] += len(words(r[1]))
    names = sorted(sizes, key=lambda s: (s is None, s))
    weights, fixed = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, {}
    while True:
        rest = sum(sizes.values()) - sum(fixed.values())
        shares = {s: rest * weights[s] / sum(weights[x] for x in names if x not in fixed) for s in names if s not in fixed}
        above = [s for s, v in shares.items() if v > 3 * sizes[s]]
        if not above:
            break
        fixed |= {s: 3 * sizes[s] for s in above}
    before = {(r[0], r[3]): Counter(words(r[1])) for r in single}
    for r in mixed:
        found = Counter(words(r[1]))
        taken[r[3]] += sum(found.values())
        assert r[4] == len(r[1]) and all(n <= 3 * before[r[0], r[3]][w] for w, n in found.items())
    assert all(abs(taken[s] - t) <= 0.02 * t + 2 * mixing.BLOCK for s, t in (fixed | shares).items())
    encode = tokens.encoder(queries.tokenizer()).encode
    have = Counter()
    for r in packed:
        have[r[0]] += r[2]
    assert have == Counter({r[0]: len(encode([r[1].encode()])[0]) // 4 + 1 for r in mixed})


@pytest.fixture(scope="module")
def long_docs(spark):
    """Texts of 150,000 words beside short ones, one of them twice, one without a gap."""
    rng = random.Random(8)
    words = [f"word{i}" for i in range(5000)] + ["é", "$5.", "and", "the"]
    big = " ".join(rng.choice(words) for _ in range(150_000))
    made = [big, big, big.replace("word1 ", "word2 "), "x" * 1_000_000, "\n".join(f"line {i} of many and the rest" for i in range(40_000)), None, ""]
    made += [" ".join(rng.choice(words) for _ in range(rng.randrange(60, 200))) for _ in range(60)]
    return spark.createDataFrame([(i, t, "en", "ab"[i % 2], len(t or "")) for i, t in enumerate(made)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).cache()


def test_very_long_texts(spark, long_docs, tmp_path):
    """Each operator gives the whole of a very long text what it gives a short one."""
    texts = {r.doc_id: r.text or "" for r in long_docs.collect()}
    count = {i: len(re.findall(WORD, t)) for i, t in texts.items()}
    mixed = {r.doc_id: r for r in mixing.mix_plan(long_docs).collect()}
    assert {i: r["size"] for i, r in mixed.items()} == count and sum(r.taken for r in mixed.values()) == pytest.approx(sum(count.values()), rel=0.01)
    library = Tokenizer.from_file(queries.tokenizer())
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    counted = {r.doc_id: (r.n_tokens, r.n_bytes) for r in tokens.token_counts(long_docs, queries.tokenizer(), str(tmp_path / "cache")).collect()}
    assert counted == {i: (len(x), len(texts[i].encode())) for i, x in ids.items()}
    pieces = {}
    for r in packing.pack_documents(long_docs, queries.tokenizer()).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    for i, parts in pieces.items():
        whole = np.array([*ids[i], 1], "<u4")
        assert sum(n for _, n, _ in parts) == len(whole) and all(zlib.crc32(whole[a : a + n].tobytes()) == c for a, n, c in parts)
    prints = {r.doc_id: r for r in fingerprints.fingerprint_documents(long_docs).collect()}
    assert prints[0].fingerprint == prints[1].fingerprint and all(r.n_chars == len(texts[i]) for i, r in prints.items())
    half, after = len(texts[2]) // 2, texts[1]
    assert prints[2].edited_sha256 == hashlib.sha256((texts[2][: len(texts[2]) - half] + after[:half]).encode()).hexdigest()
    placed = {r.doc_id: r for r in sharding.shard_documents(long_docs, 2).collect()}
    assert all(r["size"] == len(texts[i].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[i].encode()) for i, r in placed.items()) and placed[0].shard == placed[1].shard
    judged = {r.doc_id: r for r in quality.quality_rules(long_docs, quality.ACCEPT_ALL).collect()}
    assert {i: r.n_words for i, r in judged.items()} == count and judged[4].n_repeat_words == brute_quality(texts[4])[4] and not judged[0].base_failed
    scored = {r.doc_id: r for r in lm.lm_scores(long_docs).collect()}
    assert {i: r.n_tokens for i, r in scored.items()} == {i: n + 1 for i, n in count.items()} and all(r.score < 0 for r in scored.values())
    assert len(licenses.license_scan(long_docs).collect()) == len(texts)


def test_stages_keep_very_long_texts_and_clashing_columns(spark, long_docs):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    odd = long_docs.withColumns({c: F.lit(k) for k, c in enumerate(("size", "key", "row", "mark", "_mark", "_row", "nth", "h", "h_", "least", "node", "n", "value", "Start"))})
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, "/root/testdata/sf0.001").cache()
        assert docs.columns == odd.columns and docs.schema["size"].dataType == odd.schema["size"].dataType, name
        assert [tuple(r) for r in docs.select("size", "key", "row", "h", "n").distinct().collect()] == [(0, 1, 2, 7, 11)], name
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert 0 in kept and not {1, 5, 6} & kept.keys() and len(kept[0]) > 500_000
    assert {r.doc_id for r in corpus_pipeline.STAGES[3][1](spark, docs, "/root/testdata/sf0.001").collect()} == kept.keys()


def test_pipeline_leaves_its_result_alone(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from gatedframe.llm.storage import _open, exists

    result = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    root = result.inputFiles()[0].rsplit("/stage-3", 1)[0]
    assert result.count() > 150 and exists(spark, f"{root}/stage-3") and not any(exists(spark, f"{root}/stage-{k}") for k in range(3)) and len(_open) == 1
