"""A corpus pipeline of four stages: quality rules, near-duplicates, a mix of sources, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gatedframe.llm import mixing, neardup, packing, quality, queries
from gatedframe.llm.storage import Scratch, released


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the classifier reject go."""
    return quality.keep_good(docs, quality.train(docs, queries.read(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup, verified exactly: of each group linked by a five-word Jaccard similarity of 0.8 or more the document with the smallest id stays."""
    return neardup.keep_one_per_component(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become the words that the mix takes of them; documents of which it takes none go."""
    return mixing.mix_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence."""
    return packing.pack_documents(docs, queries.tokenizer())


STAGES = [("quality rules", quality_stage), ("near duplicates", near_dedup_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: The stages can't be put in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage wrote on its way goes when its result is written, and that goes when the next one is."""
    docs, scratch = queries.read(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        with released(spark):
            docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.drop(f"stage-{k - 1}")
    return docs
