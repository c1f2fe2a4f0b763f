"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where a session names none (tests on a local master), a temporary folder is made once.
    A session on a cluster without the setting is refused, since a folder of the driver's
    machine would not be seen by executors.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="gatedframe-"))
    return context.getCheckpointDir().rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


#: Rows of a few numbers each that are broadcast at most, some 20 MB.
FEW_ROWS = 500_000


def broadcast_if_few(table: DataFrame, rows: int = FEW_ROWS) -> DataFrame:
    """A written table of a few numbers a row, with the hint to broadcast it where it has ``rows`` rows at most.

    Without the hint the other side of a join would be shuffled before Spark knows that this one is small.
    """
    return F.broadcast(table) if table.count() <= rows else table


#: Folders of the ``Scratch`` objects made since the innermost ``released`` block began.
_open: list[list[str]] = [[]]


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the folders of all operators called within the block.

    The operators return lazy tables that read their intermediate ones, so results have to be written or
    collected before the block ends.
    """
    _open.append([])
    try:
        yield
    finally:
        for root in _open.pop():
            delete(spark, root)


class Scratch:
    """Tables of one operator call, written as Parquet below one folder of the shared one.

    Writing a table cuts lineage: a later job, or a task run again after an executor was
    lost, reads the files and recomputes nothing that came before.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        _open[-1].append(self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, self.path(name))
