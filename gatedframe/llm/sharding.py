"""Shards of near equal bytes by a histogram sort.

Rows are ordered by the hash of their text and then by a hash of their own, so that equal texts are
neighbours. The boundaries between shards are sought by rounds of exact counts: every round counts the bytes
below some probes within each open bracket, over all partitions at once, until each boundary is near enough to
its share. A boundary lies between two texts. Where a group of equal texts holds the share's place, the boundary goes to the group's nearer end, so that
equal texts share a shard; only a group that is larger than ``OWN_SHARE`` of a shard is cut. Rows are then exchanged once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatedframe.llm.storage import Scratch

LOWEST, BEYOND = -(1 << 63), 1 << 63
#: Bytes that a row takes besides its text.
ROW_BYTES = 16
#: Probes within each open bracket and round.
PROBES = 15
#: How far a boundary may lie from its share, in parts of a shard's bytes.
TOLERANCE = 0.005
#: Groups of equal texts up to this share of a shard's bytes stay in one shard, which they make larger or smaller than others by half of their size at most.
OWN_SHARE = 1.0
#: Rows that one task numbers, about, and the most tasks.
NUMBERED, MOST_TASKS = 100_000, 20_000


@dataclass
class _Bracket:
    """Keys low <= key < high hold the boundary: ``below`` bytes lie before low, ``under`` before high."""

    target: float
    low: int
    high: int
    below: int
    under: int
    rows: int
    at: int | None = None
    inside: bool = False


def _histogram(keys: DataFrame, key: str, probes: list[int]) -> list[tuple[int, int, int, int]]:
    """(bytes, rows, least key, greatest key) between neighbouring probes; counted within tasks and then summed."""
    edges = np.array(probes, np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(edges) + 1
        size, rows, least, most = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, BEYOND - 1, np.int64), np.full(n, LOWEST, np.int64)
        for batch in batches:
            k, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            bucket = np.searchsorted(edges, k, side="right")
            np.add.at(size, bucket, b)
            np.add.at(rows, bucket, 1)
            np.minimum.at(least, bucket, k)
            np.maximum.at(most, bucket, k)
        full = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (full, size[full], rows[full], least[full], most[full])], ["bucket", "size", "n", "least", "most"])

    counted = keys.select(key, "size").mapInArrow(run, "bucket long, size long, n long, least long, most long")
    summed = counted.groupBy("bucket").agg(F.sum("size").alias("size"), F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    found = {r.bucket: (r.size, r.n, r.least, r.most) for r in summed.collect()}  # a row per probe at most
    return [found.get(k, (0, 0, 0, 0)) for k in range(len(probes) + 1)]


def _refine(keys: DataFrame, key: str, targets: list[float], tolerance: float, whole: float) -> list[_Bracket]:
    """A boundary for each target. ``at``: keys from it on lie behind the boundary. Where no key is near enough, the boundary goes to the nearer end of the rows whose key
    holds the target; if they are many and have over ``whole`` bytes, ``inside`` is set and low is that key."""
    brackets = [_Bracket(t, LOWEST, BEYOND, 0, 0, -1) for t in targets]
    while waiting := [b for b in brackets if b.at is None and not b.inside]:
        probes: set[int] = set()
        for b in waiting:
            step = max(1, (b.high - b.low) // (PROBES + 1))
            probes |= {p for p in range(b.low + step, b.high, step)}
            probes |= {x for x in (b.low, b.high) if LOWEST < x < BEYOND}
        edges = sorted(probes)
        cells = _histogram(keys, key, edges)
        before = np.concatenate([[0], np.cumsum([c[0] for c in cells])]).tolist()  # before[i + 1]: bytes below edges[i]
        for b in waiting:
            # the last cell that begins at or below the target
            i = min(int(np.searchsorted(before, b.target, side="right")) - 1, len(cells) - 1)
            while i > 0 and not cells[i][1]:
                i -= 1
            _, b.rows, least, most = cells[i]
            b.below, b.under = before[i], before[i + 1]
            if not b.rows:
                b.at = LOWEST
                continue
            b.low, b.high = least, most + 1
            if b.target - b.below <= tolerance:
                b.at = b.low
            elif b.under - b.target <= tolerance:
                b.at = b.high
            elif least == most and (b.rows == 1 or b.under - b.below <= whole):
                b.at = b.low if b.target - b.below <= b.under - b.target else b.high
            elif least == most:
                b.inside = True
    return brackets


def find_splitters(keys: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """The shards - 1 boundaries as (h, r): a row lies behind a boundary if its own (h, r) is not less."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    allowed, whole = tolerance * total / shards, OWN_SHARE * total / shards
    found, open_ = [], {}
    for b in _refine(keys, "h", [total * j / shards for j in range(1, shards)], allowed, whole):
        if b.inside:
            open_.setdefault(b.low, []).append(b.target - b.below)
        else:
            found.append((b.at, LOWEST))
    for h, targets in open_.items():
        # a boundary must fall within one large group of equal texts
        found += [(h, b.low if b.inside else b.at) for b in _refine(keys.where(F.col("h") == h), "r", targets, allowed, 0)]
    return sorted((h, r) if h < BEYOND else (BEYOND - 1, BEYOND - 1) for h, r in ((h, min(r, BEYOND - 1)) for h, r in found))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({"size": F.octet_length(text).cast("long") + ROW_BYTES, "h": F.xxhash64(text), "r": F.xxhash64(F.col(id_col), F.monotonically_increasing_id())})


def _shard(splitters: list[tuple[int, int]]) -> Column:
    """Number of boundaries at or before a row."""
    behind = [((F.col("h") > F.lit(h)) | ((F.col("h") == F.lit(h)) & (F.col("r") >= F.lit(r)))).cast("int") for h, r in splitters]
    total = F.lit(0)
    for b in behind:
        total = total + b
    return total


def shard_documents(docs: DataFrame, shards: int = 40, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row; law is ``bytes``.

    Shards hold near equal bytes, and equal texts lie in one shard unless their group is larger than a shard. Slots count from 0 within a shard without a gap in the order of the keys, so that equal texts have neighbouring
    slots. Keys are exchanged once by range; each task numbers its range, after the sum of the ranges before it, and since
    the row's own hash is part of the key, a group of equal texts of any size is dealt to several ranges.

    A null text counts as empty. Rows that repeat an id are rows of their own. An empty table gives an
    empty result and other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "sharding")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keys = scratch.table(_keyed(slim, "doc_id", "text").select("doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), "h", "r"), "keys")
    ranges = max(1, min(MOST_TASKS, -(-keys.count() // NUMBERED)))
    dealt = keys.withColumn("shard", _shard(find_splitters(keys, shards, tolerance)))
    # the range that a row fell into is written with it, so that a task run again finds the same
    dealt = scratch.table(dealt.repartitionByRange(ranges, "shard", "h", "r").withColumn("range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("shard", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = Window.partitionBy("shard", "range").orderBy("h", "r", "doc_id")
    numbered = dealt.withColumn("nth", F.row_number().over(own) - 1)
    return numbered.join(starts, ["shard", "range"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("nth")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40, tolerance: float = TOLERANCE, parts: int = 1, id_col: str = "doc_id", text_col: str = "text", shard_col: str = "shard") -> None:
    """Writes the rows of ``docs`` as Parquet folders ``shard=0`` ..., each of about ``parts`` files, after one exchange.

    Rows of a file lie in the order of their keys, equal texts together. The columns of ``docs`` are written as they are, nulls included; the folders
    are named by ``shard_col``, with as many underscores behind it as it takes to differ from all of them (in any case of
    letters). An empty table writes no folder.
    """
    scratch = Scratch(docs.sparkSession, "sharding")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    # written with its keys, so that a task run again deals its rows as before
    keyed = scratch.table(_keyed(docs.select(row, F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "id", "text").select("row", "size", "h", "r"), "keyed")
    keys = keyed.select("size", "h", "r")
    taken = {c.lower() for c in docs.columns}
    while shard_col.lower() in taken:
        shard_col += "_"
    dealt = keyed.withColumn("shard", _shard(find_splitters(keys, shards, tolerance)))
    sorted_ = dealt.repartitionByRange(shards * parts, "shard", "h", "r").sortWithinPartitions("shard", "h", "r")
    sorted_.select("row.*", F.col("shard").alias(shard_col)).write.mode("overwrite").partitionBy(shard_col).parquet(path)
    scratch.drop("keyed")
