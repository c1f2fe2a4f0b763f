"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatedframe.llm.storage import Scratch, broadcast_if_few


def _star(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(u, v, m) with m the smallest of u and its neighbours; ``edges`` is a written table.

    The minimum is combined on the map side before it is shuffled, and written before it is joined back: with a plain
    table on both sides the edges of a node with very many neighbours can be dealt to several tasks (adaptive skew join).
    """
    least = scratch.table(edges.groupBy("u").agg(F.min("v").alias("m")), name)
    return edges.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges`` has bigint columns (u, v). Returns (node, root): root is the smallest node that
    can be reached. Nodes without an edge to another are left out.

    Each round writes its edges to the shared folder and deletes the round before. Rounds go on until the edges stay
    as they are (about the square of the logarithm of the longest path). The driver sees one count and one checksum a round, never links.
    """
    both = lambda e: e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    current = scratch.table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges-0")
    seen, n = None, 0
    while True:
        n += 1
        large = _star(both(current), scratch, f"least-large-{n}").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.table(large, f"large-{n}")
        small = _star(large, scratch, f"least-small-{n}")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        following = scratch.table(small, f"edges-{n}")
        scratch.drop(f"edges-{n - 1}", f"large-{n}", f"least-large-{n}", f"least-small-{n}")
        mark = tuple(following.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        current = following
        if mark == seen:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark


def across(members: DataFrame, roots: DataFrame, chunk: int, scratch: Scratch, name: str = "large") -> DataFrame:
    """(bucket, i, j, node): which chunks of large buckets (bucket, node) still have to meet, once ``roots`` (node, root) are known.

    Members of the bucket's largest component need not be compared with each other. They lie in chunks 0, 1, ..., all others in chunks -1, -2, ...; each chunk of
    the others meets each chunk of either kind.
    """
    large = members.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    large = scratch.table(large, name)
    sizes = large.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("a"), F.sum("n").alias("all"), F.count("*").alias("kinds"))
    chunks = lambda n: F.ceil(n / chunk).cast("long")
    largest = scratch.table(largest.where("kinds > 1").select("bucket", "main", chunks(F.col("a")).alias("a"), chunks(F.col("all") - F.col("a")).alias("b")), f"{name}st")
    parts = large.join(broadcast_if_few(largest), "bucket")
    parts = parts.withColumn("c", F.when(F.col("root") == F.col("main"), F.expr("pmod(xxhash64(node, bucket), a)")).otherwise(F.expr("-1 - pmod(xxhash64(node, bucket), b)")))
    other = F.expr("transform(sequence(1L, b), x -> -x)")
    met = F.when(F.col("c") >= 0, other).otherwise(F.concat(F.expr("sequence(0L, a - 1)"), other))
    dealt = parts.select("bucket", "c", "node", F.explode(met).alias("o"))
    return dealt.select("bucket", F.greatest("c", "o").alias("i"), F.least("c", "o").alias("j"), "node")
