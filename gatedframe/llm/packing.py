"""Packing documents into sequences of a fixed length by first-fit decreasing."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatedframe.llm.storage import Scratch
from gatedframe.llm.tokens import encoder
from gatedframe.llm.words import pieces, utf8

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Number of the row in its task, so that rows which share an id are told apart.
NTH = ", nth long"


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size, largest first and ties in the order given.

    A tournament tree holds every bin's free space at its leaves and the larger of two children
    above; the first bin with room is found, and its path renewed, in as many steps as the tree is high.
    """
    n = len(sizes)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    leaves = 1 << max(0, n - 1).bit_length()
    free = [capacity] * (2 * leaves)
    for k in np.argsort(-sizes, kind="stable").tolist():
        size, node = int(sizes[k]), 1
        while node < leaves:
            node *= 2
            if free[node] < size:
                node += 1
        bins[k], offsets[k] = node - leaves, capacity - free[node]
        free[node] -= size
        while node > 1:
            node //= 2
            best = max(free[2 * node], free[2 * node + 1])
            if free[node] == best:
                break
            free[node] = best
    return bins, offsets


def token_pieces(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, nth[, ids]): each document's ids and the end id, cut every ``length`` ids."""
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "nth", *["ids"] * with_ids]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, step, nth = encoder(tokenizer_path).encode, 4 * length, TaskContext.get().partitionId() << 40
        for batch in pieces(batches):
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), encode(utf8(batch.column(1)))):
                ids += end
                nth += 1
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    rows.append((doc, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4, nth, *[np.frombuffer(part, "<u4").astype(np.int32)] * with_ids))
            cols = list(zip(*rows)) or [()] * len(names)
            types = [pa.int64()] * 6 + [pa.list_(pa.int32())] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECE + NTH + ", ids array<int>" * with_ids)


def pack_documents(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1, group_docs: int = 4096, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Documents are dealt by a seeded hash to groups of about ``group_docs``, and each group packs its pieces on its
    own, so the work of a task is bounded and a lost one repeats a group alone. A document of more than ``length`` ids
    is cut every ``length`` ids; full pieces fill a sequence each. A sequence's id is its group's number times
    2^32 plus its own number in the group.

    A null or empty text still has the end id and so one piece. Rows that repeat an id are packed as
    documents of their own. An empty table gives an empty result and other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    cut = scratch.table(token_pieces(docs, tokenizer_path, length, end_id, id_col, text_col), "pieces")
    groups = max(1, -(-cut.where("start = 0").count() // group_docs))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "nth", "start"], ascending=[False, True, True, True], kind="stable")
        sizes = pdf["length"].to_numpy()
        full = int((sizes == length).sum())
        bins, offsets = first_fit_decreasing(sizes[full:], length)
        pdf["sequence_id"] = (int(pdf["grp"].iloc[0]) << 32) + np.concatenate([np.arange(full), full + bins])
        pdf["offset"] = np.concatenate([np.zeros(full, np.int64), offsets])
        return pdf.drop(columns=["grp", "nth"])

    dealt = cut.withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "doc_tokens", "nth"), F.lit(groups)))
    return dealt.groupBy("grp").applyInPandas(pack, PIECE + ", sequence_id long, offset long")


def sequences(docs: DataFrame, packed: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sequence_id, ids): the packed ids themselves, without the padding.

    Pieces of ``packed`` are matched by id (null or not), place, length, checksum and the document's tokens, so that rows which repeat an id, or an id and a
    text, each have theirs. A null text is packed as its end id alone, and empty tables give no sequence.
    """
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    ids = token_pieces(docs, tokenizer_path, length, end_id, id_col, text_col, with_ids=True).dropDuplicates(key).select(*key, "ids")
    ids = Scratch(docs.sparkSession, "sequences").table(ids, "ids")
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"i.{c}")) for c in key]
    joined = packed.alias("p").join(ids.alias("i"), same).select("sequence_id", F.struct("offset", "ids").alias("part"))
    return joined.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["ids"])).alias("ids"))
