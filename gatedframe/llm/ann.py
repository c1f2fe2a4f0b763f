"""Nearest neighbours by inner product, from a robust-pruned directed graph in each shard.

Vectors are dealt to shards by a hash. Within a shard a vector gets one more component that brings all to one length, so that the largest inner product
with a query is the least distance, and nodes are inserted in batches that double: a greedy search over the graph so far proposes neighbours, and of these
the nearest is kept again and again while all that lie relaxed nearer to it than to the node are dropped, which keeps edges in every direction. Edges back are added and
pruned alike. A query searches each shard with a beam, and the shards' finds are merged.

Vectors that are alike to the last bit are one node. Copies come back in at the end: of each node its members with the smallest ids, one more than neighbours are asked for, are all that can be among them.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatedframe.llm.storage import Scratch, broadcast_if_few

#: Edges of a node, nodes that a search holds while building, and how much nearer to a kept edge a candidate must be to be dropped.
DEGREE, BUILD_BEAM, RELAXED = 32, 64, 1.2
#: Nodes that a query holds in a shard of up to ``LEAST_ROWS``; in a larger one as many times more as the root of its size, which keeps recall.
BEAM = 96
#: Nodes that a search opens at once.
WIDTH = 4
#: Vectors of a shard at most, and shards of at least ``LEAST_ROWS`` that a smaller table is dealt to.
SHARD_ROWS, LEAST_ROWS, SHARDS = 65_536, 4096, 8
#: Queries searched at once, and queries for which a shard is sent to a task.
QUERIES, QUERY_BLOCK = 128, 500_000
#: Copies of the beam's best that are scored in double precision, per neighbour asked for.
RESCORED = 2


def beam_search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, beam: int, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, similarities) that greedy searches from node 0 opened, (queries, any), -1 where there are fewer. ``seen`` is (queries, nodes), all false, and is left so."""
    n = len(queries)
    ids, sims, opened = np.full((n, beam), -1, np.int32), np.full((n, beam), -np.inf, np.float32), np.zeros((n, beam), bool)
    ids[:, 0], sims[:, 0] = 0, queries @ x[0]
    seen[:n, 0] = True
    touched, out = [(np.arange(n), np.zeros(n, np.int64))], []
    live = np.arange(n)
    while len(live):
        waiting = np.where(opened[live], -np.inf, sims[live])
        at = np.argpartition(-waiting, min(WIDTH, beam - 1), 1)[:, :WIDTH]
        best = np.take_along_axis(waiting, at, 1)
        some = np.isfinite(best).any(1)
        live, at, best = live[some], at[some], best[some]
        if not len(live):
            break
        nodes = np.where(np.isfinite(best), np.take_along_axis(ids[live], at, 1), -1)
        step_ids, step_sims = np.full((n, nodes.shape[1]), -1, np.int32), np.full((n, nodes.shape[1]), -np.inf, np.float32)
        step_ids[live], step_sims[live] = nodes, best
        out.append((step_ids, step_sims))
        opened[live[:, None], at] = True
        around = np.sort(np.where(nodes[:, :, None] >= 0, graph[nodes], -1).reshape(len(live), -1), 1)
        new = around >= 0
        new[:, 1:] &= around[:, 1:] != around[:, :-1]
        row, col = np.nonzero(new)
        node = around[row, col]
        fresh = ~seen[live[row], node]
        row, node = row[fresh], node[fresh]
        seen[live[row], node] = True
        touched.append((live[row], node))
        counts = np.bincount(row, minlength=len(live))
        place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        more_ids, more_sims = np.full((len(live), max(1, counts.max(initial=0))), -1, np.int32), np.full((len(live), max(1, counts.max(initial=0))), -np.inf, np.float32)
        more_ids[row, place] = node
        more_sims[row, place] = np.einsum("ij,ij->i", x[node], queries[live[row]])
        all_ids, all_sims = np.concatenate([ids[live], more_ids], 1), np.concatenate([sims[live], more_sims], 1)
        all_opened = np.concatenate([opened[live], np.zeros(more_ids.shape, bool)], 1)
        keep = np.argpartition(-all_sims, beam - 1, 1)[:, :beam]
        ids[live], sims[live], opened[live] = (np.take_along_axis(a, keep, 1) for a in (all_ids, all_sims, all_opened))
    for row, node in touched:
        seen[row, node] = False
    return np.concatenate([o[0] for o in out], 1), np.concatenate([o[1] for o in out], 1)


def robust_prune(x: np.ndarray, candidates: np.ndarray, sims: np.ndarray, degree: int, relaxed: float) -> np.ndarray:
    """(nodes, degree) diverse edges among ``candidates`` (nodes, any; -1 for none) of these similarities to the node."""
    order = np.argsort(-sims, 1, kind="stable")
    candidates, sims = np.take_along_axis(candidates, order, 1), np.take_along_axis(sims, order, 1)
    vectors, far, alive = x[candidates], 1 - sims, candidates >= 0
    out, each = np.full((len(candidates), degree), -1, np.int32), np.arange(len(candidates))
    for k in range(degree):
        pick = alive.argmax(1)
        has = alive[each, pick]
        if not has.any():
            break
        out[:, k] = np.where(has, candidates[each, pick], -1)
        between = 1 - np.matmul(vectors, vectors[each, pick][:, :, None])[:, :, 0]
        alive &= relaxed * between > far
        alive[each, pick] = False
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relaxed: float = RELAXED) -> np.ndarray:
    """Edges (nodes, degree), -1 for none, of vectors of length one in the order in which they are inserted."""
    n = len(x)
    graph, held, done = np.full((n, degree), -1, np.int32), np.zeros(n, np.int64), 1
    seen = np.zeros((QUERIES, n), bool)
    while done < n:
        stop = min(n, done * 2, done + max(4 * QUERIES, n // 32))
        for a in range(done, stop, QUERIES):
            batch = np.arange(a, min(stop, a + QUERIES))
            found, sims = beam_search(x, graph, x[batch], beam, seen)
            graph[batch] = robust_prune(x, found, sims, degree, relaxed)
        _edges_back(x, graph, held, np.arange(done, stop), degree, relaxed)
        done = stop
    return graph


def _edges_back(x: np.ndarray, graph: np.ndarray, held: np.ndarray, batch: np.ndarray, degree: int, relaxed: float) -> None:
    """Adds an edge from each neighbour of the new nodes to them, and prunes what gets too many."""
    held[batch] = (graph[batch] >= 0).sum(1)
    source, target = np.repeat(batch, degree), graph[batch].ravel()
    source, target = source[target >= 0], target[target >= 0]
    sims = np.einsum("ij,ij->i", x[source], x[target])
    order = np.lexsort((-sims, target))
    source, target, sims = source[order], target[order], sims[order]
    nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
    nth = np.arange(len(target)) - np.repeat(first, counts)
    fits = held[nodes] + counts <= degree
    add = np.repeat(fits, counts)
    graph[target[add], held[target[add]] + nth[add]] = source[add]
    held[nodes[fits]] += counts[fits]
    crowded = nodes[~fits]
    for k in range(0, len(crowded), 4 * QUERIES):
        some = crowded[k : k + 4 * QUERIES]
        within = (nth < 2 * degree) & np.isin(target, some)  # of very many new ones the nearest
        candidates = np.full((len(some), 3 * degree), -1, np.int32)
        candidates[:, :degree] = graph[some]
        candidates[np.searchsorted(some, target[within]), degree + nth[within]] = source[within]
        near = np.where(candidates >= 0, np.matmul(x[candidates], x[some][:, :, None])[:, :, 0], -np.inf)
        graph[some] = robust_prune(x, candidates, near, degree, relaxed)
        held[some] = (graph[some] >= 0).sum(1)


def unit_space(vectors: np.ndarray) -> np.ndarray:
    """Vectors with one more component that brings all to the length of the longest, scaled to one."""
    v = vectors.astype(np.float64)
    v /= np.abs(v).max()
    v /= np.sqrt((v * v).sum(1).max())
    return np.concatenate([v, np.sqrt(np.maximum(0, 1 - (v * v).sum(1)))[:, None]], 1).astype(np.float32)


def _directions(queries: np.ndarray) -> np.ndarray:
    q = queries.astype(np.float64)
    q /= np.abs(q).max(1, keepdims=True)
    q /= np.sqrt((q * q).sum(1, keepdims=True))
    return np.concatenate([q, np.zeros((len(q), 1))], 1).astype(np.float32)


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


NODE_DDL = "shard int, node int, vec_id long, d1 long, d2 long, vector array<double>, edges array<int>"
NODES = pa.schema([("shard", pa.int32()), ("node", pa.int32()), ("vec_id", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("vector", pa.list_(pa.float64())), ("edges", pa.list_(pa.int32()))])


def _rows_of(batches: Iterable[pa.RecordBatch], *keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(key, slice) of rows that lie together by the integer columns ``keys``."""
    for batch in batches:
        if batch.num_rows:
            table = np.stack([batch.column(k).to_numpy() for k in keys], 1)
            bounds = [0, *(np.flatnonzero((table[1:] != table[:-1]).any(1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(bounds, bounds[1:]):
                yield tuple(table[a].tolist()), batch.slice(a, b - a)


def _built(degree: int, beam: int, relaxed: float):
    """Rows (shard, vec_id, d1, d2, vector) by shard to nodes with edges. A shard, of a bounded size, is held whole."""

    def nodes(shard: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        vectors = _matrix(rows.column(4).combine_chunks())
        x = unit_space(vectors)
        # the order of insertion is that of a hash, but for the one nearest to the middle, from which searches start
        order = np.lexsort((rows.column(3).to_numpy(), rows.column(2).to_numpy()))
        middle = int(np.argmax(x[order] @ x.mean(0, dtype=np.float64).astype(np.float32)))
        order[[0, middle]] = order[[middle, 0]]
        graph, rows = build_graph(x[order], degree, beam, relaxed), rows.take(pa.array(order))
        n, flat = len(order), graph.ravel()
        counts = np.concatenate([[0], np.cumsum((graph >= 0).sum(1))]).astype(np.int32)
        edges = pa.ListArray.from_arrays(pa.array(counts), pa.array(flat[flat >= 0]))
        columns = [pa.array(np.full(n, shard, np.int32)), pa.array(np.arange(n, dtype=np.int32)), *(rows.column(k).combine_chunks() for k in (1, 2, 3, 4)), edges]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, NODES)], schema=NODES)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        for (key,), rows in _rows_of(batches, 0):
            if held and key != shard:
                yield nodes(shard, held)
                held = []
            shard = key
            held.append(rows)
        if held:
            yield nodes(shard, held)

    return run


HIT_DDL = "q1 long, q2 long, score double, vec_id long, d1 long, d2 long"


def _searched(beam: int, wanted: int):
    """Rows (shard, block, query, node, vec_id, d1, d2, vector, edges), by shard and block, nodes in order before queries, to (q1, q2, score, vec_id, d1, d2): of each query the ``wanted`` best of
    the shard. A shard's nodes are held, queries pass by."""

    def hits(vectors: np.ndarray, x: np.ndarray, graph: np.ndarray, named: list[np.ndarray], seen: np.ndarray, rows: pa.RecordBatch) -> pa.RecordBatch:
        queries = _matrix(rows.column(7))
        found, sims = beam_search(x, graph, _directions(queries), max(RESCORED * wanted, beam_for(len(x), beam)), seen)
        some = min(found.shape[1], RESCORED * wanted)
        best = np.argpartition(-sims, some - 1, 1)[:, :some]
        found = np.take_along_axis(found, best, 1)
        scores = np.where(found >= 0, np.einsum("qnd,qd->qn", vectors[found], queries), -np.inf)
        order = np.lexsort((named[0][found], -scores), axis=1)[:, :wanted]
        found, scores = np.take_along_axis(found, order, 1), np.take_along_axis(scores, order, 1)
        row, col = np.nonzero(found >= 0)
        node = found[row, col]
        columns = [rows.column(5).to_numpy()[row], rows.column(6).to_numpy()[row], scores[row, col], *(n[node] for n in named)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["q1", "q2", "score", "vec_id", "d1", "d2"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, ready = None, [], None
        for (shard, block, query), rows in _rows_of(batches, 0, 1, 2):
            if (shard, block) != at:
                at, held, ready = (shard, block), [], None
            if not query:
                held.append(rows)
                continue
            if not held:  # a shard without nodes
                continue
            if ready is None:
                nodes = pa.Table.from_batches(held).combine_chunks()
                vectors, edges = _matrix(nodes.column(7).combine_chunks()), nodes.column(8).combine_chunks()
                ends = edges.offsets.to_numpy()
                graph = np.full((len(vectors), max(1, int(np.diff(ends).max(initial=0)))), -1, np.int32)
                graph[np.arange(graph.shape[1]) < np.diff(ends)[:, None]] = edges.flatten().to_numpy()
                ready = vectors, unit_space(vectors), graph, [nodes.column(k).to_numpy() for k in (4, 5, 6)], np.zeros((QUERIES, len(vectors)), bool)
            for k in range(0, rows.num_rows, QUERIES):
                yield hits(*ready, rows.slice(k, QUERIES))

    return run


def _usable(vector: Column, size: int) -> Column:
    """Whether a vector has this many numbers, all finite and not all zero."""
    finite = lambda x: x.isNotNull() & (F.abs(x) < float("inf"))  # noqa: E731  NaN is greater than infinity
    return vector.isNotNull() & (F.size(vector) == size) & F.forall(vector, lambda x: F.coalesce(finite(x), F.lit(False))) & F.exists(vector, lambda x: x != 0)


def _prepared(vectors: DataFrame, id_col: str, vector_col: str, scratch: Scratch) -> DataFrame:
    """(vec_id, d1, d2, vector) with one row for each id, written."""
    plain = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector")).where("vec_id is not null and vector is not null")
    lengths = plain.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).limit(1).collect()  # one row
    usable = plain.where(_usable(F.col("vector"), lengths[0].size if lengths else 0))
    hashed = usable.select("vec_id", F.struct(F.xxhash64("vector").alias("d1"), F.xxhash64(F.lit(1), "vector").alias("d2"), "vector").alias("v"))
    return scratch.table(hashed.groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", "v.d1", "v.d2", "v.vector"), "vectors")


def shard_count(nodes: int) -> int:
    """Shards for so many nodes: of ``SHARD_ROWS`` at most, and of ``LEAST_ROWS`` while there are fewer than ``SHARDS``."""
    return max(1, -(-nodes // SHARD_ROWS), min(SHARDS, -(-nodes // LEAST_ROWS)))


def beam_for(nodes: int, beam: int = BEAM) -> int:
    return round(beam * math.sqrt(max(1.0, nodes / LEAST_ROWS)))


def _one_each(df: DataFrame, parts: int, at: Column) -> DataFrame:
    return df.repartitionById(parts, at.cast("int"))


def build_index(nodes: DataFrame, shards: int, degree: int = DEGREE, beam: int = BUILD_BEAM, relaxed: float = RELAXED) -> DataFrame:
    """(shard, node, vec_id, d1, d2, vector, edges) of (vec_id, d1, d2, vector), one row for each different vector: a graph in each shard, whose searches start at node 0. Edges name nodes of the shard."""
    dealt = nodes.select(F.pmod(F.col("d1"), F.lit(shards)).cast("int").alias("shard"), "vec_id", "d1", "d2", "vector")
    return _one_each(dealt, shards, F.col("shard")).sortWithinPartitions("shard").mapInArrow(_built(degree, beam, relaxed), NODE_DDL)


def search_index(index: DataFrame, queries: DataFrame, shards: int, wanted: int, beam: int = BEAM) -> DataFrame:
    """(q1, q2, score, vec_id, d1, d2): of each query (d1, d2, vector) the ``wanted`` best nodes of every shard, with their exact inner products."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = F.lit(None).cast("array<int>").alias("edges")
    held = index.select("shard", every(blocks).alias("block"), F.lit(0).alias("query"), "node", "vec_id", "d1", "d2", "vector", "edges")
    block = F.pmod(F.xxhash64("d1", "d2"), F.lit(blocks)).cast("int").alias("block")
    asked = queries.select(every(shards).alias("shard"), block, F.lit(1).alias("query"), F.lit(0).alias("node"), F.lit(0).cast("long").alias("vec_id"), "d1", "d2", "vector", none)
    stream = _one_each(held.union(asked), shards * blocks, F.col("shard") * blocks + F.col("block")).sortWithinPartitions("shard", "block", "query", "node")
    return stream.mapInArrow(_searched(beam, wanted), HIT_DDL)


def nearest(
    vectors: DataFrame, query: Column | None = None, k: int = 20, degree: int = DEGREE, build_beam: int = BUILD_BEAM, beam: int = BEAM, relaxed: float = RELAXED, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``query`` picks (a condition on ``vec_id``; all rows if left out) the ``k`` rows found nearest by inner product in double precision, ties to the smaller id.

    A query's own id is not among them; where fewer rows take part all that the search reaches are given. Vectors that are null, zero, of another length than most, or that hold a null or a
    number that isn't finite take no part, nor do rows without an id; of rows that repeat an id the one with the least hash of its vector does. Every row is indexed. An empty table gives an empty result, and other
    columns are not read.

    Copies of a vector, be they a third of all rows, are one node, and are cut to the k + 1 smallest ids before they meet in one task (a partial limit in each task that reads them); a search for all that ask
    with the same vector is made once.
    """
    scratch = Scratch(vectors.sparkSession, "ann")
    rows = _prepared(vectors, id_col, vector_col, scratch)
    copies = Window.partitionBy("d1", "d2").orderBy("vec_id")
    members = scratch.table(rows.withColumn("nth", F.row_number().over(copies)).where(F.col("nth") <= k + 1).withColumn("vector", F.when(F.col("nth") == 1, F.col("vector"))), "members")
    nodes = members.where("nth = 1").select("vec_id", "d1", "d2", "vector")
    shards = shard_count(nodes.count())
    index = scratch.table(build_index(nodes, shards, degree, build_beam, relaxed), "index")

    asking = rows if query is None else rows.where(query)
    asked = scratch.table(asking.select(F.col("vec_id").alias("query_id"), F.col("d1").alias("q1"), F.col("d2").alias("q2")), "asked")
    distinct = scratch.table(asked.select(F.col("q1").alias("d1"), F.col("q2").alias("d2")).distinct(), "distinct")
    queries = scratch.table(nodes.select("d1", "d2", "vector").join(broadcast_if_few(distinct), ["d1", "d2"], "left_semi"), "queries")
    best = lambda df: df.withColumn("nth", F.row_number().over(Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "vec_id"))).where(F.col("nth") <= k + 1).drop("nth")
    hits = scratch.table(best(search_index(index, queries, shards, k + 1, beam)), "hits")
    # copies come back in: a node among the best brings its members
    met = hits.select("q1", "q2", "score", "d1", "d2").join(members.select("d1", "d2", "vec_id"), ["d1", "d2"])
    listed = best(met.select("q1", "q2", "score", "vec_id")).groupBy("q1", "q2").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))).alias("found"))  # k + 1 each
    found = asked.join(scratch.table(listed, "listed"), ["q1", "q2"])
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return found.select("query_id", F.posexplode(others).alias("i", "x")).select("query_id", (F.col("i") + 1).alias("rank"), "x.vec_id", (-F.col("x.far")).alias("score"))
