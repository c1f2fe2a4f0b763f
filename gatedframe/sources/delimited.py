"""Delimited text: separator detection, headers, repair of ragged rows, and types inferred from cells. ``quoted`` cuts the text into records."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatedframe.errors import QueryError
from gatedframe.functions.coerce import READS, choose_type, coerce_columns, trim, type_counts
from gatedframe.model import RID, STRING, Dataset, Field, to_dataset_id, unique_dataset_id
from gatedframe.sources.quoted import file_lines, records, text_records

SEPARATORS = (",", "\t", ";", "|")
SAMPLE_CHARS, SAMPLE_LINES = 64_000, 20
#: Rows kept and bytes taken from a delimited file, unless the caller asks for more.
MOST_ROWS, MOST_BYTES = 100_000, 25 * 1024 * 1024
ENDINGS = (".csv", ".tsv", ".txt")
#: Files of one path that each become a dataset of its own, unless the caller asks for more.
MOST_FILES = 200
BOM = "\ufeff"


def detect_delimiter(text: str) -> str:
    """The separator that occurs most outside quotes in the first lines (ended by LF or CRLF); ties in the order of ``SEPARATORS``."""
    sample = text.encode("utf-16-le", "surrogatepass")[: 2 * SAMPLE_CHARS].decode("utf-16-le", "ignore")
    outside = "\n".join(sample.split("\n")[:SAMPLE_LINES]).split('"')[::2]  # a doubled quote closes and opens
    return max(SEPARATORS, key=lambda s: sum(part.count(s) for part in outside))


def dedupe_header(names: list[str]) -> tuple[list[str], list[str]]:
    """Blank names become column_<n>; a name met again gets its number behind it."""
    seen: dict[str, int] = {}
    out, repeated = [], False
    for i, name in enumerate(names):
        name = name or f"column_{i + 1}"
        seen[name] = seen.get(name, 0) + 1
        repeated |= seen[name] > 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out, ["Some column names occurred more than once and were numbered."] if repeated else []


@dataclass
class _File:
    """``key`` is the file's name as rows have it, ``path`` as the file system takes it."""

    key: str
    path: str
    length: int
    separator: str = ""
    unit: str = ""

    @property
    def name(self) -> str:
        return self.path.rsplit("/", 1)[-1]

    def look(self, head: bytes, separator: str | None) -> None:
        """Finds the separator and what ends lines from the first bytes. Lines end with LF unless the text only has CR."""
        text = head.decode("utf-8", "replace").removeprefix(BOM)
        self.separator, self.unit = separator or detect_delimiter(text), "\r" if "\r" in text and "\n" not in text else "\n"


def _head(spark: SparkSession, path: str) -> bytes:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        return bytes(stream.readNBytes(4 * SAMPLE_CHARS))
    finally:
        stream.close()


def build_dataset(spark: SparkSession, name: str, content: bytes, taken: Iterable[str] = (), separator: str | None = None, most_rows: int | None = MOST_ROWS) -> Dataset:
    """A dataset from delimited text that the driver holds."""
    file = _File(name, name, len(content))
    file.look(content[: 4 * SAMPLE_CHARS], separator)
    found, kept = text_records(spark, name, content.removeprefix(BOM.encode()), file.separator, file.unit)
    return _datasets(spark, found.withColumn("base", F.lit(0)), kept, [file], taken, most_rows)[0]


def _of_files(spark: SparkSession, path: str, files: list[_File], one: bool) -> tuple[DataFrame, list[DataFrame]]:
    """Records of files with ``base``, the number of rows in the splits before their own."""
    units = {f.key: f.unit for f in files}
    found, kept = records(file_lines(spark, path, {files[0].key: files[0].unit} if one else units), {f.key: f.separator for f in files}, units)
    sizes = found.groupBy("key", "start").agg(F.count_if(~_heading()).alias("n"))
    before = Window.partitionBy(*([] if one else ["key"])).orderBy("key", "start").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("key", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return found.join(F.broadcast(bases), ["key", "start"]), kept  # a row for each split, which ``records`` has counted


def _heading() -> Column:
    return (F.col("start") == 0) & (F.col("idx") == 0)


def _datasets(spark: SparkSession, found: DataFrame, kept: list[DataFrame], files: list[_File], taken: Iterable[str], most_rows: int | None, one: str | None = None) -> list[Dataset]:
    """A dataset of each file, or one named ``one`` of all of them, each of which then begins with the header.

    However many files there are, the same few jobs cut them, count their rows and infer their types. Types are inferred once, from the rows that are kept.
    """
    heading = _heading()
    named = found.where(heading) if one is None else found.where(heading & (F.col("key") == files[0].key))
    first = {r.key: r.fields for r in named.select("key", "fields").collect()}  # a row for each dataset
    heads = {f.key: dedupe_header([trim(n) for n in first[f.key]]) if f.key in first else ([], ["The file is empty."]) for f in (files if one is None else files[:1])}
    widths = spark.createDataFrame([(k, len(names)) for k, (names, _) in heads.items()], "dataset string, width int")
    numbered = found.where(~heading)
    body = numbered.select((F.col("key") if one is None else F.lit(files[0].key)).alias("dataset"), (F.col("base") + F.col("idx") - F.when(F.col("start") == 0, 1).otherwise(0)).alias(RID), "fields")
    cells = F.size("fields")
    counts = body.join(F.broadcast(widths), "dataset").groupBy("dataset").agg(F.count(F.lit(1)).alias("rows"), F.count_if(cells < F.col("width")).alias("short"), F.count_if(cells > F.col("width")).alias("long"))
    counted = {r.dataset: r for r in counts.collect()}
    body = body if most_rows is None else body.where(F.col(RID) < most_rows)
    most = max(len(names) for names, _ in heads.values())
    raw = body.select("dataset", RID, *(F.coalesce(F.get("fields", F.lit(i)), F.lit("")).alias(f"c{i}") for i in range(most)))
    types = {r.dataset: r for r in type_counts(raw, [f"c{i}" for i in range(most)], "dataset").collect()} if most else {}
    out: list[Dataset] = []
    alive = set(heads)
    for key, (names, warnings) in heads.items():
        file, c, t = next(f for f in files if f.key == key), counted.get(key), types.get(key)
        rows = c.rows if c else 0
        for n, what in ((c.short if c else 0, "had too few cells and {} filled with blanks"), (c["long"] if c else 0, "had too many cells and {} cut")):
            if n:
                warnings.append(f"{n} row{'' if n == 1 else 's'} {what.format('was' if n == 1 else 'were')}.")
        if most_rows is not None and rows > most_rows:
            warnings.append(f"Only the first {most_rows:,} of {rows:,} rows were loaded.")
        fields = []
        for i, name in enumerate(names):
            seen = [t[f"{i}_{j}"] for j in range(4)] if t else [0] * 4
            kind = choose_type(*seen)
            fields.append(Field(name, kind, f"c{i}", 0 if kind == STRING else seen[0] - seen[READS[kind]]))
        own = raw.where(F.col("dataset") == key).select(RID, *(f.physical for f in fields))
        df = coerce_columns(own, {f.physical: f.type for f in fields}).select(RID, *(f.physical for f in fields)).cache()
        name = one or file.name
        size = file.length if one is None else sum(f.length for f in files)

        def release(key: str = key) -> None:
            alive.discard(key)
            if not alive:
                for table in kept:
                    table.unpersist()

        made = Dataset(unique_dataset_id(to_dataset_id(name), [*taken, *(d.id for d in out)]), name, df, fields, rows if most_rows is None else min(rows, most_rows), rows, size, warnings)
        made.release = release
        out.append(made)
    return out


def _listed(spark: SparkSession, path: str, separator: str | None, most_bytes: int | None, most_files: int | None) -> list[_File]:
    """The files of a path, none of them read but for its first bytes."""
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("key"), "path", "length")
    listed = [_File(*r) for r in sorted((files if most_files is None else files.orderBy("key").limit(most_files + 1)).collect())]
    if not listed:
        raise QueryError("empty_file", "The path has no file with content.")
    if most_files is not None and len(listed) > most_files:
        raise QueryError("too_many_files", f"The path has over {most_files} files.")
    for f in listed:
        if not f.path.lower().endswith(ENDINGS):
            raise QueryError("unsupported_file", f'"{f.name}" is none of {", ".join(ENDINGS)}.')
        if most_bytes is not None and f.length > most_bytes:
            raise QueryError("file_too_large", f'"{f.name}" has {f.length:,} bytes; {most_bytes:,} are taken at most.')
    return listed


def load_delimited(
    spark: SparkSession, path: str, taken: Iterable[str] = (), separator: str | None = None, most_rows: int | None = MOST_ROWS, most_bytes: int | None = MOST_BYTES, most_files: int | None = MOST_FILES
) -> list[Dataset]:
    """A dataset of each delimited file of a path that Spark reads, be it a file, a folder or a pattern; in the order of their paths.

    Contents are read on the executors, a large file by many tasks. All files are looked at before the first is loaded: one whose name doesn't end in one of ``ENDINGS``, or
    of over ``most_bytes``, is refused with all others, and so is a path without files or with a file without a column. None lifts a limit.
    """
    files = _listed(spark, path, separator, most_bytes, most_files)
    for f in files:
        f.look(_head(spark, f.path), separator)
    found = _datasets(spark, *_of_files(spark, path, files, False), files, taken, most_rows)
    if empty := [d.name for d in found if not d.fields]:
        for d in found:
            d.release()
        raise QueryError("empty_file", f'"{empty[0]}" has no columns.')
    return found


def load_delimited_table(spark: SparkSession, path: str, name: str | None = None, taken: Iterable[str] = (), separator: str | None = None, most_rows: int | None = None) -> Dataset:
    """All delimited files of a path as one dataset, such as a table that was written in parts: each file begins with the same header, which is read from the first, and rows come in the order of the paths. There is no limit of rows, bytes or files."""
    files = _listed(spark, path, separator, None, None)
    files[0].look(_head(spark, files[0].path), separator)
    for f in files[1:]:
        f.separator, f.unit = files[0].separator, files[0].unit
    found = _datasets(spark, *_of_files(spark, path, files, True), files, taken, most_rows, name or path.rstrip("/").rsplit("/", 1)[-1])[0]
    if not found.fields:
        raise QueryError("empty_file", f'"{found.name}" has no columns.')
    return found
