"""Choosing one row of each group of near duplicates by a key of the row itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatedframe.llm.storage import broadcast_if_few


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, key, text): all columns of ``docs`` as one struct, and a key that orders rows by id, those without one last, then by text.

    The text stands in the key as 128 bits of hash, so that rows which share an id but not the text are told apart.
    """
    text = F.col(text_col)
    key = F.struct(
        F.col(id_col).isNull().alias("last"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).cast("long").alias("id"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")
    )
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key.alias("key"), text.alias("text"))


def kept(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of ``docs`` for each of ``keys`` (key), a written table."""
    flat = [F.col(f"key.{n}").alias(n) for n in ("last", "id", "a", "b")]
    wanted = keys.select(*flat)
    hashed = [F.col(f"row.`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    met = keyed(docs, id_col, text_col).select("row", *flat).join(broadcast_if_few(wanted), ["last", "id", "a", "b"], "left_semi")
    first = Window.partitionBy("last", "id", "a", "b").orderBy(F.xxhash64(*hashed))
    return met.withColumn("nth", F.row_number().over(first)).where("nth = 1").select("row.*")
