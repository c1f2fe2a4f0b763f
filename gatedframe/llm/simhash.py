"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint is cut into segments of two bits, and the vector of segment popcounts is an embedding
whose Manhattan distance never exceeds the Hamming distance. For the grid, each half of 32 bits is
embedded twice, with segments that begin at even and at odd bits, so that its cell tells fingerprints apart
nearly as well as its bits do. Two fingerprints that differ in at most four bits differ in at most two in one of
the halves, so some half is one bit away from both. The grid's cells have the width of one count. The range join enters every
fingerprint in its own cell of each half and in the cells a Manhattan distance of one away in both embeddings that a half one bit away can
have; fingerprints that meet in a cell are candidates, the whole embedding's distance is the lower bound that drops most
of them, and the differing bits are counted for the rest.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatedframe.llm import survivors
from gatedframe.llm.components import across, connected_components
from gatedframe.llm.storage import Scratch, broadcast_if_few
from gatedframe.llm.words import ASCII_LOWER, pieces, utf8

HASH_SEED = 42
#: Links are searched within radius 2 of a half; more differing bits would need more cells.
MAX_BITS = 4
#: Members of a cell that are compared in one task; a larger cell is cut into chunks, of which those outside the cell's largest component meet the others.
CHUNK = 2048
#: Fingerprints whose cells one task makes, about.
TASK_NODES = 30_000
#: Cells of up to so many members are compared lag by lag over all cells at once; larger ones one by one.
SMALL = 16
LANES = np.uint64(0x5555555555555555)


def fingerprint(text: bytes, width: int = 4) -> bytes:
    """Eight bytes: a bit is set where it is set in over half of the shingles' hashes."""
    words = text.translate(ASCII_LOWER).split()
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths) + np.arange(len(words))
    starts = (ends - lengths).tolist()
    ends = ends.tolist()[width - 1 :] or ends.tolist()[-1:]
    digest, total, n = xxhash.xxh64_digest, np.zeros(64, np.int64), len(ends)
    for at in range(0, n, 65536):
        part = b"".join([digest(joined[a:b], HASH_SEED) for a, b in zip(starts[at : at + 65536], ends[at : at + 65536])])
        total += np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > n).tobytes()


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(key, fp) of ``docs`` (key, text): the fingerprint of each row as a signed bigint. A null text has none of the
    words and so fingerprint zero."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = b"".join(fingerprint(t, width) for t in utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.frombuffer(found, ">i8").astype(np.int64))], ["key", "fp"])

    return docs.select("key", "text").mapInArrow(run, f"key {docs.schema['key'].dataType.simpleString()}, fp long")


def _cells(nodes: DataFrame) -> DataFrame:
    """(cell, fp): for both halves, the cells of the half and of those one bit away."""
    halves = F.array(
        F.struct(F.lit(0).alias("half"), F.expr("shiftrightunsigned(fp, 32)").alias("x")),
        F.struct(F.lit(1).alias("half"), F.expr("fp & 4294967295L").alias("x")),
    )
    split = nodes.select("fp", F.explode(halves).alias("h")).select("fp", "h.half", "h.x")
    near = split.select("fp", "half", F.explode(F.expr("concat(array(x), transform(sequence(0, 31), k -> x ^ shiftleft(1L, k)))")).alias("x"))
    turned = near.withColumn("y", F.expr("shiftright(x, 1) | shiftleft(x & 1L, 31)"))
    counts = lambda c: F.expr(f"{c} - (shiftright({c}, 1) & 1431655765L)")  # noqa: E731  popcounts of 16 segments
    return turned.select(F.xxhash64("half", counts("x"), counts("y")).alias("cell"), "fp")


def _lanes(fp: np.ndarray) -> np.ndarray:
    return fp - ((fp >> np.uint64(1)) & LANES)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Manhattan distance of two arrays of packed vectors with values 0 to 2 in 2-bit lanes."""
    d, e = np.uint64(0x3333333333333333), np.uint64(2)
    total = np.zeros(np.broadcast_shapes(x.shape, y.shape), np.uint64)
    for shift in (np.uint64(0), e):
        a, b = (x >> shift) & d, (y >> shift) & d
        up = (a | np.uint64(0x8888888888888888)) - b  # each nibble: 8 + a - b
        same = up & np.uint64(0x8888888888888888)
        low = up & np.uint64(0x7777777777777777)
        less = (same ^ np.uint64(0x8888888888888888)) >> np.uint64(3)  # 1 where a < b
        total += (low ^ (less * np.uint64(7))) + less
    # nibbles hold sums up to 4
    total = (total & np.uint64(0x0F0F0F0F0F0F0F0F)) + ((total >> np.uint64(4)) & np.uint64(0x0F0F0F0F0F0F0F0F))
    return (total * np.uint64(0x0101010101010101)) >> np.uint64(56)


def _linked(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= bits


def _dense(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (root, member) of the components of one cell's members."""
    left, roots, members = fps, [], []
    while len(left) > 1:
        front, rest, root = left[:1], left[1:], left[0]
        while len(front) and len(rest):
            hit, lanes = np.zeros(len(rest), bool), _lanes(rest)
            for at in range(0, len(front), 64):
                open_, met = np.flatnonzero(~hit), front[at : at + 64]
                if not len(open_):
                    break
                row, column = np.nonzero(_apart(lanes[open_][:, None], _lanes(met)[None, :]) <= bits)
                hit[open_[row[_linked(rest[open_[row]], met[column], bits)]]] = True
            front, rest = rest[hit], rest[~hit]
            roots.append(np.full(len(front), root, np.uint64))
            members.append(front)
        left = rest
    none = np.zeros(0, np.uint64)
    return np.concatenate(roots or [none]), np.concatenate(members or [none])


def _links(bits: int):
    """Edges among the members of each (cell, i, j), which arrive sorted by it.

    A run of equal keys that reaches the end of a batch waits for the next one; it is at most two chunks long.
    """
    empty = [np.zeros(0, np.int64)] * 4

    def edges(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        cell, i, j, fp = cols
        fp = fp.view(np.uint64)
        new = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])) if len(cell) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(new, len(cell)))
        group = np.repeat(np.arange(len(new)), sizes)
        small = np.repeat(sizes <= SMALL, sizes)
        us, vs = [], []
        f, g, lanes = fp[small], group[small], _lanes(fp[small])
        for lag in range(1, SMALL):
            at = np.flatnonzero(g[lag:] == g[:-lag])
            if not len(at):
                break
            at = at[_apart(lanes[at], lanes[at + lag]) <= bits]
            at = at[_linked(f[at], f[at + lag], bits)]
            us.append(f[at])
            vs.append(f[at + lag])
        for k in np.flatnonzero(sizes > SMALL):
            u, v = _dense(np.unique(fp[new[k] : new[k] + sizes[k]]), bits)
            us.append(u)
            vs.append(v)
        if not us:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        pair = np.unique(np.stack([np.concatenate(us), np.concatenate(vs)], axis=1), axis=0)
        return pair[:, 0].copy(), pair[:, 1].copy()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = empty
        for batch in batches:
            cols = [np.concatenate([h, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for h, c in zip(held, batch.columns)]
            if not len(cols[0]):
                continue
            last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1])
            cut = int(np.argmax(last))
            held = [c[cut:] for c in cols]
            u, v = edges([c[:cut] for c in cols])
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])
        u, v = edges(held)
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return run


def link_edges(nodes: DataFrame, max_bits: int = MAX_BITS, scratch: Scratch | None = None) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``nodes.fp`` whose components are those of all
    pairs with at most ``max_bits`` differing bits.

    Members of cells are counted first (combined on the map side), and the cells met twice or more are joined back as a plain table,
    so no task gathers the members of a cell. A cell with over ``CHUNK`` members is cut into chunks, in another way in each cell, so that links within chunks join most of its members; only
    those outside its largest component then meet the other chunks. No group holds more than two chunks, and a task returns stars of what it found linked, never all pairs of a dense cell.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"max_bits is 0 to {MAX_BITS}")
    scratch = scratch or Scratch(nodes.sparkSession, "links")
    cells = _cells(nodes.repartition(max(1, -(-nodes.count() // TASK_NODES)), "fp"))
    met = scratch.table(cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"), "met")
    members = cells.join(broadcast_if_few(met), "cell").withColumn("k", F.ceil(F.col("n") / CHUNK).cast("long"))
    meeting = lambda dealt: dealt.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(_links(max_bits), "u long, v long")
    own = F.expr("pmod(xxhash64(fp, cell), k)")
    edges = meeting(members.select("cell", own.alias("i"), own.alias("j"), "fp"))
    if not met.where(F.col("n") > CHUNK).limit(1).count():
        return edges
    edges = scratch.table(edges, "cell-links")
    roots = scratch.table(connected_components(edges, scratch), "cell-roots")
    others = across(members.where("k > 1").select(F.col("cell").alias("bucket"), F.col("fp").alias("node")), roots, CHUNK, scratch, "large-cell")
    return edges.union(meeting(others.select(F.col("bucket").alias("cell"), "i", "j", F.col("node").alias("fp"))))


def _classes(keyed: DataFrame, scratch: Scratch, width: int, max_bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of ``keyed`` (key, text): (key, fp), (fp, root), and (root, least) with the least key of the component."""
    marks = scratch.table(fingerprints(keyed, width), "fingerprints")
    nodes = scratch.table(marks.groupBy("fp").agg(F.min("key").alias("least")), "nodes")
    roots = connected_components(link_edges(nodes, max_bits, scratch), scratch)
    placed = scratch.table(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "placed")
    named = scratch.table(placed.groupBy("root").agg(F.min("least").alias("least")), "named")
    scratch.drop("nodes", "met")
    return marks, placed.select("fp", "root"), named


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Fingerprints are linked at ``max_bits`` or fewer differing bits; component_id is the smallest
    doc_id that links reach. Rows are matched through their fingerprint, so repeated rows and
    repeated ids each keep their own output row. A null text counts as empty; a null id takes part in
    links but never names a component unless all ids of the component are null. An empty table
    gives an empty result. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    keyed = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    marks, placed, named = _classes(keyed, scratch, width, max_bits)
    classes = scratch.table(placed.join(named, "root").select("fp", F.col("least").alias("component_id")), "classes")
    scratch.drop("placed", "named")
    return marks.join(classes, "fp").select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component, with all columns of ``docs``: that with the smallest id.

    A row without an id stands behind all that have one. Of rows that repeat the smallest id of their component the one with the smallest text hash
    stays, then that with the smallest hash of all columns; rows alike in every column count once. Rows of other components that share the
    id are none of its business. Columns of any name come back as they were.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    named = _classes(survivors.keyed(docs, id_col, text_col).select("key", "text"), scratch, width, max_bits)[2]
    return survivors.kept(docs, named.select(F.col("least").alias("key")), id_col, text_col)
