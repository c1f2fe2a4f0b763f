"""Typed tables as datasets. Columns keep their Spark types; nested ones are left out with a warning."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatedframe.model import RID, Dataset, Field, logical_type, to_dataset_id, unique_dataset_id

#: A row's number in its file is below this.
FILE_ROWS = 1 << 40
#: Files whose paths are numbered, so that a row's place is one number; their paths are broadcast, some 20 MB at most.
MOST_FILES = 100_000


def _numbered(df: DataFrame, files: list[str]) -> DataFrame:
    """``_rid`` of rows of files: files in the order of their paths, rows as they lie in a file.

    It is a number, which aggregations keep in fixed-width buffers; of more files than can be numbered it is (path, row), in the same order.
    """
    file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    if len(files) <= 1:
        return df.withColumn(RID, row)
    if len(files) > MOST_FILES:
        return df.withColumn(RID, F.struct(file.alias("file"), row.alias("row")))
    named = [re.sub(r"^([^:/]+):///", r"\1:/", f) for f in sorted(files)]  # as the rows name them
    paths = df.sparkSession.createDataFrame([(f, i) for i, f in enumerate(named)], "_path string, _nth long")
    at = df.withColumns({"_file": file, "_row": row}).join(F.broadcast(paths), F.col("_file") == F.col("_path"), "left")
    return at.withColumn(RID, F.coalesce("_nth", F.lit(len(files))) * F.lit(FILE_ROWS) + F.col("_row")).drop("_file", "_row", "_path", "_nth")


def from_frame(df: DataFrame, name: str, taken: Iterable[str] = ()) -> Dataset:
    """``df`` as a dataset. NaN and infinities count as blanks. Only columns that a query names are read later.

    Rows of files appear in the order of the files' paths and of the rows in them; those of any other DataFrame in that of its partitions.
    """
    fields, columns, warnings = [], [], []
    for i, f in enumerate(df.schema.fields):
        kind = logical_type(f.dataType)
        if kind is None:
            warnings.append(f'Column "{f.name}" of type {f.dataType.simpleString()} was left out.')
            continue
        fields.append(Field(f.name, kind, f"c{i}", floating=isinstance(f.dataType, (T.DoubleType, T.FloatType))))
        columns.append(F.col(f"`{f.name}`").alias(f"c{i}"))
    dataset = Dataset(unique_dataset_id(to_dataset_id(name), taken), name, df.select(*columns), fields, warnings=warnings)
    try:
        df.select("_metadata.row_index")
    except AnalysisException:  # not rows of files
        dataset.number = lambda rows: rows.withColumn(RID, F.monotonically_increasing_id())
        return dataset
    files: list[str] = []

    def number(rows: DataFrame) -> DataFrame:
        if not files:
            files.extend(df.inputFiles())
        return _numbered(rows, files)

    dataset.number = number
    return dataset


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to as many tasks as run at once, where a file of one row group would have one task read it and do all that follows."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)


def load_parquet(spark: SparkSession, path: str, taken: Iterable[str] = ()) -> Dataset:
    return from_frame(spark.read.parquet(path), path.rstrip("/").rsplit("/", 1)[-1], taken)
