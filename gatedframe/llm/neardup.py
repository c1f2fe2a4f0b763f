"""Near-duplicates of a five-word Jaccard similarity of 0.8 or more: SimHash and MinHash find candidates, exact similarity decides.

A document is the set of its five-word shingles, as 64-bit hashes; documents with the same set are one node. The SimHash
operator links nodes whose fingerprints (of the same hashes) differ in at most four bits, which finds near exact
copies and few others: at similarity 0.8 some ten bits differ. So each of 32 bands besides joins five smallest hashes, and
documents of similarity 0.8 share a band but for 0.672^32, 3 pairs in a million. A component of fingerprints and a value of a band are
buckets alike; the members of a bucket are compared set by set where their task holds them, and buckets with the same members once. A bucket of more members
than a task takes is cut into chunks. Each chunk is compared within itself first; what its members then are linked to, here or in other
buckets, needs no more comparing, and only members outside the bucket's largest component meet the other chunks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatedframe.llm import simhash, survivors
from gatedframe.llm.components import across, connected_components
from gatedframe.llm.storage import Scratch, broadcast_if_few
from gatedframe.llm.words import ASCII_LOWER, pieces, utf8

WIDTH = 5
#: Documents are linked from this similarity on: 4 of 5.
NUM, DEN = 4, 5
BANDS, ROWS = 32, 5
#: Members of a bucket that meet in one task; a larger bucket is cut into chunks, and every two chunks meet.
CHUNK = 256
#: Entries of a task's dictionary before it is emptied, and shingles whose smallest hashes are taken at once.
FLUSH, PART = 250_000, 4096
_RNG = np.random.default_rng(23)
_TURNS = _RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)
_PLACES = _RNG.integers(0, 1 << 64, max(WIDTH, ROWS), np.uint64) | np.uint64(1)
_SALTS = _RNG.integers(0, 1 << 64, BANDS, np.uint64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word, 42)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, hashes: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a text of fewer words than a shingle is one shingle, one without words none."""
    words = text.translate(ASCII_LOWER).split()
    codes = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n, width = max(len(codes) - WIDTH + 1, min(len(codes), 1)), min(len(codes), WIDTH)
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total += codes[k : k + n] * _PLACES[k]
    return np.unique(_mixed(total))


def _node(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), 42)


def _fingerprint(found: np.ndarray) -> int:
    """SimHash of shingle hashes, unsigned; zero for none."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(found), PART):
        total += np.unpackbits(found[at : at + PART].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(found)).tobytes(), "big")


def _least(found: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(found), PART):
        np.minimum(least, (found[at : at + PART] * _TURNS).min(axis=1), out=least)
    return least


def _marks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    for batch in pieces(batches):
        if len(hashes) > FLUSH:
            hashes.clear()
        sets = [shingle_set(t, hashes) for t in utf8(batch.column(1))]
        if not sets:
            continue
        nodes = np.array([_node(s) for s in sets], np.uint64)
        least = np.stack([_least(s) for s in sets]).reshape(len(sets), BANDS, ROWS)
        marks = np.array([_fingerprint(s) for s in sets], np.uint64)
        bands = _mixed((_mixed(least) * _PLACES[:ROWS]).sum(axis=2, dtype=np.uint64) + _SALTS)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel().view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes.view(np.int64)), pa.array(marks.view(np.int64)), lists], ["key", "node", "fp", "bands"])


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    for batch in pieces(batches):
        if len(hashes) > FLUSH:
            hashes.clear()
        sets = [shingle_set(t, hashes) for t in utf8(batch.column(0))]
        nodes = np.array([_node(s) for s in sets], np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])


def linked_stars(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges (root, member) of the components of all pairs with a similarity of at least NUM / DEN."""
    sizes = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    ids = [flat[e - n : e] for e, n in zip(ends, sizes)]
    held = np.zeros(len(flat) + 1, bool)
    left, edges = list(range(len(sets))), []
    while len(left) > 1:
        root, front, rest = left[0], left[:1], np.array(left[1:])
        whole = None
        while front and len(rest):
            one = front.pop()
            if whole is None:
                whole, begins = np.concatenate([ids[k] for k in rest]), np.cumsum(sizes[rest]) - sizes[rest]
            held[ids[one]] = True
            # a set is never empty here: the empty one is a node of its own
            common = np.add.reduceat(held[whole], begins, dtype=np.int64)
            held[ids[one]] = False
            hit = DEN * common >= NUM * (sizes[one] + sizes[rest] - common)
            if hit.any():
                found = rest[hit].tolist()
                edges += [(root, k) for k in found]
                front += found
                rest, whole = rest[~hit], None
        left = rest.tolist()
    return edges


def _links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges among the members of each (bucket, i, j), which arrive sorted by it; one group is held at a time."""
    key, nodes, sets = None, [], []

    def edges() -> pa.RecordBatch:
        pairs = [(nodes[a], nodes[b]) for a, b in linked_stars(sets)] if len(sets) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["u", "v"])

    for batch in pieces(batches):
        for *at, node, shingles in zip(*(c.to_pylist() for c in batch.columns)):
            if at != key:
                yield edges()
                key, nodes, sets = at, [], []
            if len(shingles):
                nodes.append(node)
                sets.append(np.frombuffer(shingles, np.uint64))
    yield edges()


def least_of_components(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Of ``docs`` (key, text): the least key of each component of links of similarity 0.8 or more, as column ``key``."""
    kind = docs.schema["key"].dataType.simpleString()
    marks = docs.mapInArrow(_marks, f"key {kind}, node long, fp long, bands array<long>")
    nodes = marks.groupBy("node").agg(F.min("key").alias("least"), F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands"))
    nodes = scratch.table(nodes, "nodes")
    alike = connected_components(simhash.link_edges(nodes.select("fp").distinct(), scratch=scratch), scratch)
    alike = scratch.table(alike, "alike")
    by_mark = nodes.select("node", "fp").join(alike, F.col("fp") == alike.node, "left").select(nodes.node, F.xxhash64(F.lit("simhash"), F.coalesce("root", "fp")).alias("bucket"))
    entered = nodes.select("node", F.explode("bands").alias("bucket")).union(by_mark)
    # counted on the map side first, so that no task gathers the members of a common bucket
    met = scratch.table(entered.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("members")).where("n > 1"), "buckets")
    first = scratch.table(met.groupBy("n", "members").agg(F.min("bucket").alias("bucket")), "first")
    members = entered.join(broadcast_if_few(first), "bucket").select("bucket", "node", F.ceil(F.col("n") / CHUNK).cast("long").alias("k"))
    members = scratch.table(members, "members")
    wanted = scratch.table(nodes.select("node", "least").join(members.select("node").distinct(), "node", "left_semi").select(F.col("least").alias("key")).distinct(), "wanted")
    sets = docs.join(broadcast_if_few(wanted), "key", "left_semi").select("text").mapInArrow(_sets, "node long, shingles binary")
    sets = scratch.table(sets.groupBy("node").agg(F.any_value("shingles").alias("shingles")), "sets")

    def compared(dealt: DataFrame, name: str) -> DataFrame:
        groups = dealt.join(sets, "node").select("bucket", "i", "j", "node", "shingles")
        return scratch.table(groups.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(_links, "u long, v long"), name)

    own = F.expr("pmod(xxhash64(node, bucket), k)")
    edges = compared(members.select("bucket", own.alias("i"), own.alias("j"), "node"), "links")
    if members.where("k > 1").limit(1).count():
        roots = scratch.table(connected_components(edges, scratch), "linked")
        edges = edges.union(compared(across(members.where("k > 1").select("bucket", "node"), roots, CHUNK, scratch), "links-across"))
    roots = connected_components(edges, scratch)
    placed = nodes.join(roots, nodes.node == roots.node, "left").select("least", F.coalesce("root", nodes.node).alias("root"))
    named = scratch.table(placed.groupBy("root").agg(F.min("least").alias("key")).select("key"), "named")
    scratch.drop("nodes", "alike", "met", "buckets", "first", "members", "wanted", "sets", "links", "linked", "links-across", "large", "largest", "parts")
    return named


def keep_one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all columns of ``docs``: that with the smallest id.

    A row without an id stands behind all that have one. Of rows that repeat the smallest id of their component the one with the smallest text hash
    stays, then that with the smallest hash of all columns; rows alike in every column count once. Rows of other components that share the
    id are none of its business. Texts without words are alike. Columns of any name come back as they were, and an empty table stays one.
    """
    keys = least_of_components(survivors.keyed(docs, id_col, text_col).select("key", "text"), Scratch(docs.sparkSession, "neardup"))
    return survivors.kept(docs, keys, id_col, text_col)
