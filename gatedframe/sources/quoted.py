"""Records of quoted, delimited text, cut by many tasks at once.

A quote opens only an empty field, a doubled one stands for itself, and what follows the closing quote is kept. LF, CRLF and CR end a record; an open
quote runs to the end of the file.

Spark reads the files as lines, in splits of its own choice. At the start of a line only two things can be: it stands within quotes or it doesn't. A first pass finds, for both,
how each split ends; these are chained split after split, which gives how each one begins. A second pass then cuts every split into records. A record
that begins in one split and ends in a later one leaves its parts, which are put together by the split that it began in.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatedframe.errors import QueryError

#: Splits whose beginnings are broadcast, some 20 MB; at Spark's 128 MB a split, 64 TB of text.
MOST_SPLITS = 500_000
#: Records that leave a task together.
FLUSH = 4096
#: Lines at the end of a batch that may belong to a record which ends in the next one, for the others to be cut at once.
TAIL = 4
#: Bytes from which on quotes are looked at all at once.
LONG = 4096
MARKS = re.compile(rb'["\r\n]')
PIECES = "key string, start long, idx long, kind int, fields array<string>, raw binary"
#: Kinds of pieces: a record; the end of one that began in an earlier split, or all of a split within it; the beginning of one that ends later.
WHOLE, ENDING, PASSING, OPENING = range(4)


@dataclass(frozen=True)
class Grammar:
    """Patterns for one separator, a single ASCII character. ``unit`` is the character that ends the lines as they are read."""

    separator: str
    unit: str = "\n"

    def __post_init__(self) -> None:
        if len(self.separator) != 1 or not self.separator.isascii() or self.separator in '"\r\n':
            raise QueryError("invalid_separator", f"{self.separator!r} can't separate cells; one ASCII character can that is no quote and ends no line.")

    def _built(self, pattern: str) -> re.Pattern:
        return re.compile(pattern.replace("S", re.escape(self.separator)).encode(), re.DOTALL)

    @functools.cached_property
    def outside(self) -> re.Pattern:
        """As much of a line as can be read from its start; all of it unless a quote stays open."""
        field = r'(?>"(?:[^"]++|"")*+"[^S\r\n]*+|[^"S\r\n][^S\r\n]*+|)'
        return self._built(rf"(?:{field}[S\r\n])*+{field}")

    @functools.cached_property
    def inside(self) -> re.Pattern:
        """The same for a line that begins within quotes; no match if they stay open."""
        field = r'(?>"(?:[^"]++|"")*+"[^S\r\n]*+|[^"S\r\n][^S\r\n]*+|)'
        return self._built(rf'(?:[^"]++|"")*+"[^S\r\n]*+(?:[S\r\n](?:{field}[S\r\n])*+{field})?+')

    @functools.cached_property
    def field(self) -> re.Pattern:
        return self._built(r'(?:"((?:[^"]++|"")*+)(?:"([^S\r\n]*+)|\Z)|([^"S\r\n][^S\r\n]*+|))(S|\r\n|\r|\n|\Z)')

    def ends_inside(self, line: bytes, inside: bool) -> bool:
        """Whether quotes are open behind a line, or behind several with what ends them in between."""
        if b'"' not in line:
            return inside
        if len(line) >= LONG:
            text = np.frombuffer(line, np.uint8)
            quotes = np.flatnonzero(text == 34)
            if self.alternate(text, quotes, inside):
                return bool(len(quotes) + inside & 1)
        found = (self.inside if inside else self.outside).match(line)
        return found is None or found.end() < len(line)

    def alternate(self, text: np.ndarray, quotes: np.ndarray, inside: bool = False) -> bool:
        """Whether each other quote of a text opens an empty field or is the second of a doubled one, so that all others close or are the first: open quotes are then told by counting."""
        opening = quotes[int(inside) :: 2]
        before = text[opening - (opening > 0)]
        return bool(((opening == 0) | (before == ord(self.separator)) | (before == 10) | (before == 13) | ((before == 34) & (opening > 0))).all())

    def records(self, text: bytes) -> Iterator[list[str]]:
        """Records of a text that begins outside quotes. The last one needs no line end, and isn't one if it is an empty cell."""
        record, at, end, mark = [], 0, len(text), self.separator.encode()
        while at < end:
            m = self.field.match(text, at)
            quoted, rest, plain, stop = m.groups()
            cell = plain if quoted is None else quoted.replace(b'""', b'"') + (rest or b"")
            at = m.end()
            if stop or cell or record:
                record.append(cell.decode("utf-8", "replace"))
            if stop == mark:
                if at == end:
                    yield [*record, ""]
            elif record:
                yield record
                record = []


    def closed_records(self, text: bytes) -> Iterator[list[str]]:
        """``records`` of a text that ends with a line end outside quotes."""
        record, mark = [], self.separator.encode()
        for quoted, rest, plain, stop in self.field.findall(text):
            if stop or plain:
                record.append((plain or quoted.replace(b'""', b'"') + rest).decode("utf-8", "replace"))
            if record and stop != mark:
                yield record
                record = []


@functools.lru_cache(256)
def grammar(separator: str, unit: str) -> Grammar:
    return Grammar(separator, unit)


def file_lines(spark: SparkSession, path: str, units: dict[str, str]) -> DataFrame:
    """(key, start, size, value): the lines of files, by the file's name as Spark has it, the split that they begin in, and the file's bytes. ``units`` has what ends the lines of each file."""
    found = []
    for unit in sorted(set(units.values())):
        read = spark.read.option("lineSep", unit).text(path)
        named = [F.col("_metadata.file_path").alias("key"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size")]
        read = read.select(*named, F.col("value").cast("binary").alias("value"))
        found.append(read if len(set(units.values())) == 1 else read.where(F.col("key").isin([k for k, u in units.items() if u == unit])))
    return functools.reduce(DataFrame.union, found)


def text_records(spark: SparkSession, key: str, text: bytes, separator: str, unit: str) -> tuple[DataFrame, list[DataFrame]]:
    """``records`` of a text that the driver holds, as one split."""
    content = spark.createDataFrame([(bytearray(text),)], "content binary").coalesce(1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held in batch.column(0).to_pylist():
                lines = held.split(unit.encode())
                ended = lines[-1] == b""
                cutter = _Cutter(grammar(separator, unit), (key, 0), False, True, ended)
                lines = lines[:-1] if ended else lines
                for k in range(0, len(lines), FLUSH):
                    yield from cutter.lines(pa.array(lines[k : k + FLUSH], pa.binary()))
                yield cutter.finished()

    pieces = content.mapInArrow(run, PIECES).persist()
    return pieces.select("key", "start", "idx", "fields"), [pieces]


def _joined_lines(values: pa.Array, unit: str) -> bytes:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), unit.encode())[0].as_py()


def _splits(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Runs of lines of one split; a task may read several, one after the other."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, starts = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
        names = keys.indices.to_numpy()
        bounds = [0, *(i + 1 for i in range(batch.num_rows - 1) if names[i] != names[i + 1] or starts[i] != starts[i + 1]), batch.num_rows] if names[0] != names[-1] or starts[0] != starts[-1] else [0, batch.num_rows]
        for a, b in zip(bounds, bounds[1:]):
            yield (keys.dictionary[int(names[a])].as_py(), int(starts[a])), batch.slice(a, b - a)


def _ends(grammars: dict[str, Grammar], whole: Grammar | None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], list] = {}  # a split's lines lie in one task
        for at, lines in _splits(batches):
            g, values = whole or grammars[at[0]], lines.column(3)
            now = seen.setdefault(at, [False, True, 0, int(lines.column(2)[0].as_py())])
            now[2] += (pc.sum(pc.binary_length(values)).as_py() or 0) + lines.num_rows
            quoted = values.filter(pc.match_substring(values, b'"'))
            if not len(quoted):
                continue
            text, same = _joined_lines(quoted, g.unit), now[0] == now[1]  # lines without a quote change nothing
            now[0] = g.ends_inside(text, now[0])
            now[1] = now[0] if same else g.ends_inside(text, now[1])
        rows = [(key, start, *state) for (key, start), state in seen.items()]
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)], ["key", "start", "outside", "inside", "bytes", "size"])

    return run


def _chained(splits: pd.DataFrame) -> pd.DataFrame:
    """How each split of one file begins, whether it is the last, and whether a line end stands behind the last line (a byte order mark, of three bytes, isn't read as part of a line)."""
    splits, inside, out = splits.sort_values("start"), False, []
    for r in splits.itertuples():
        out.append((r.key, r.start, inside, False, True))
        inside = bool(r.inside if inside else r.outside)
    ended = int(splits["size"].iloc[0] - splits["bytes"].sum()) in (0, 3)
    out[-1] = (*out[-1][:3], True, ended)
    return pd.DataFrame(out, columns=["key", "start", "begins", "last", "ended"])


class _Cutter:
    """Cuts the lines of one split into records."""

    def __init__(self, g: Grammar, at: tuple[str, int], begins: bool, last: bool, ended: bool):
        self.g, self.at, self.last, self.ended, self.unit = g, at, last, ended, g.unit.encode()
        self.inside, self.heading, self.idx = begins, begins, 0
        self.open: list[bytes] = []  # lines of a record whose quotes are open
        self.out: list[tuple] = []
        self.held: bytes | None = None
        self.after_unit = at[1] > 0

    def _emit(self, fields: list[str]) -> None:
        if fields == [""] and (self.at[1] or self.idx):
            return  # a blank line is no record, but for the first of a file
        self.out.append((*self.at, self.idx, WHOLE, fields, None))
        self.idx += 1

    def _part(self, kind: int) -> None:
        self.out.append((*self.at, self.idx if kind == OPENING else 0, kind, None, b"".join(self.open)))
        self.open = []

    def line(self, line: bytes, close: bytes) -> None:
        if self.unit == b"\r" and self.after_unit and not self.inside and line[:1] == b"\n":
            line = line[1:]  # the second half of a CRLF
        self.after_unit = True
        if not self.open and not self.inside and not MARKS.search(line):
            self._emit(line.decode("utf-8", "replace").split(self.g.separator))
            return
        self.inside = self.g.ends_inside(line, self.inside)
        self.open.append(line + close)
        if self.inside:
            return
        if self.heading:
            self.heading = False
            self._part(ENDING)
            return
        text, self.open = b"".join(self.open), []
        for fields in self.g.records(text):
            self._emit(fields)

    def lines(self, values: pa.Array) -> Iterator[pa.RecordBatch]:
        """All lines but the last seen are cut at once; what stands behind the last of a file is known at its end only."""
        if self.held is not None:
            self.line(self.held, self.unit)
        body, self.held = values.slice(0, len(values) - 1), values[len(values) - 1].as_py()
        if not self.inside and self.unit == b"\n" and (fields := self._plain(body)) is not None:
            if self.out:
                yield self.flushed()
            yield fields
            return
        if not self.inside and not self.open and self.unit == b"\n" and (found := self._alternating(body)) is not None:
            done, fields = found
            if self.out:
                yield self.flushed()
            yield fields
            self.after_unit = True
            values = body.slice(done).to_pylist()
            done = 0
        else:
            values = body.to_pylist()
            done = self._closed(values)
        if len(self.out) >= FLUSH:
            yield self.flushed()
        for value in values[done:]:
            self.line(value, self.unit)
            if len(self.out) >= FLUSH:
                yield self.flushed()

    def _closed(self, values: list[bytes]) -> int:
        """Cuts, all at once, as many lines as end outside quotes but for ``TAIL`` at most, and says how many; none where that many don't."""
        if self.inside or self.open or self.unit != b"\n":
            return 0
        for n in range(len(values), max(0, len(values) - TAIL), -1):
            text = b"\n".join(values[:n]) + b"\n"
            if not self.g.ends_inside(text, False):
                for fields in self.g.closed_records(text):
                    self._emit(fields)
                self.after_unit = True
                return n
        return 0

    def _plain(self, values: pa.Array) -> pa.RecordBatch | None:
        """Lines of UTF-8 without a quote or CR, which Arrow splits alone; None if they hold one."""
        if not len(values) or pc.any(pc.match_substring_regex(values, r'["\r]')).as_py():
            return None
        try:
            text = values.cast(pa.string())
        except pa.ArrowInvalid:
            return None
        filled = pc.not_equal(text, "").to_numpy(zero_copy_only=False)
        if not self.at[1] and not self.idx:
            filled[0] = True  # the first record of a file
        text = text.filter(pa.array(filled))
        return self._batch(pc.split_pattern(text, self.g.separator).cast(pa.list_(pa.string())))

    def _alternating(self, values: pa.Array) -> tuple[int, pa.RecordBatch] | None:
        """How many lines end with the last record that ends in these, and the records; cut all at once by the places of separators, line ends and quotes. None if there is no such
        record, or quotes don't alternate, or there is a CR, or text that isn't UTF-8."""
        if not len(values):
            return None
        text = np.frombuffer(_joined_lines(values, "\n") + b"\n", np.uint8)
        quote = text == 34
        quotes = np.flatnonzero(quote)
        if (text == 13).any() or not self.g.alternate(text, quotes):
            return None
        outside = (np.cumsum(quote, dtype=np.uint8) & 1) == 0
        stops = np.flatnonzero(((text == ord(self.g.separator)) | (text == 10)) & outside)
        ends = np.flatnonzero(text[stops] == 10)  # the stops that end records
        if not len(ends):
            return None
        stops = stops[: ends[-1] + 1]
        text, quotes = text[: stops[-1] + 1], quotes[quotes < stops[-1]]
        keep = np.ones(len(text), bool)
        keep[stops] = keep[quotes] = False
        keep[quotes[2::2][quotes[2::2] == quotes[1:-1:2] + 1]] = True  # one of two that are doubled
        data, bounds = text[keep], np.concatenate([[0], np.cumsum(keep)[stops]]).astype(np.int32)
        cells = pa.Array.from_buffers(pa.binary(), len(stops), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        try:
            cells = cells.cast(pa.string())
        except pa.ArrowInvalid:
            return None
        first = np.concatenate([[0], ends[:-1] + 1])
        blank = (first == ends) & (bounds[ends] == bounds[ends + 1])
        if not self.at[1] and not self.idx:
            blank[0] = False
        fields = pa.ListArray.from_arrays(pa.array([0, *(ends + 1)], pa.int32()), cells)
        return int((text == 10).sum()), self._batch(fields.filter(pa.array(~blank)) if blank.any() else fields)

    def _batch(self, fields: pa.Array) -> pa.RecordBatch:
        n, same = len(fields), lambda v, t: pa.array([v] * len(fields), t)
        self.idx += n
        columns = [same(self.at[0], pa.string()), same(self.at[1], pa.int64()), pa.array(range(self.idx - n, self.idx), pa.int64()), same(WHOLE, pa.int32()), fields, pa.nulls(n, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, schema=SCHEMA)

    def flushed(self) -> pa.RecordBatch:
        columns = zip(*self.out) if self.out else [[]] * len(SCHEMA)
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA)], schema=SCHEMA)
        self.out = []
        return batch

    def finished(self) -> pa.RecordBatch:
        if self.held is not None:
            self.line(self.held, self.unit if self.ended or not self.last else b"")
        if self.open and self.last and not self.heading:  # quotes that nothing closes
            for fields in self.g.records(b"".join(self.open)):
                self._emit(fields)
        elif self.open:
            self._part(PASSING if self.heading else OPENING)
        return self.flushed()


SCHEMA = pa.schema([("key", pa.string()), ("start", pa.int64()), ("idx", pa.int64()), ("kind", pa.int32()), ("fields", pa.list_(pa.string())), ("raw", pa.binary())])


def _cut(grammars: dict[str, Grammar], whole: Grammar | None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter: _Cutter | None = None
        for at, lines in _splits(batches):
            if cutter is None or cutter.at != at:
                if cutter is not None:
                    yield cutter.finished()
                begins, last, ended = (lines.column(k)[0].as_py() for k in (4, 5, 6))
                if begins is None:
                    raise RuntimeError("the files were split another way than before; load them again")
                cutter = _Cutter(whole or grammars[at[0]], at, begins, last, ended)
            yield from cutter.lines(lines.column(3))
        if cutter is not None:
            yield cutter.finished()

    return run


def _joined(grammars: dict[str, Grammar], whole: Grammar | None):
    def run(parts: pd.DataFrame) -> pd.DataFrame:
        """Records whose parts lie in several splits; they stand behind the whole ones of the split that they began in."""
        parts = parts.sort_values(["start", "kind"])
        opening = parts[parts["kind"] == OPENING].iloc[0]
        key, start, idx = opening["key"], int(opening["start"]), int(opening["idx"])
        out = []
        for fields in (whole or grammars[key]).records(b"".join(parts["raw"])):
            if fields != [""] or (start == 0 and idx + len(out) == 0):
                out.append((key, start, idx + len(out), fields))
        return pd.DataFrame(out, columns=["key", "start", "idx", "fields"])

    return run


def records(lines: DataFrame, separators: dict[str, str], units: dict[str, str]) -> tuple[DataFrame, list[DataFrame]]:
    """(key, start, idx, fields): the records of ``lines`` in the order of (start, idx) within each file, idx without a gap from 0 in each split; and the tables that are kept for it. The first
    record of a file is kept even if it is blank, other blank lines are no records.

    ``separators`` and ``units`` have each file's; where all files share one of each, files need not be named. Rows read again after a lost executor are cut the same way, as a plan keeps its splits.
    """
    pairs = {(separators[k], units[k]) for k in separators}
    whole = grammar(*pairs.pop()) if len(pairs) == 1 else None
    grammars = {} if whole else {k: grammar(separators[k], units[k]) for k in separators}
    ends = lines.mapInArrow(_ends(grammars, whole), "key string, start long, outside boolean, inside boolean, bytes long, size long")
    begun = ends.groupBy("key").applyInPandas(_chained, "key string, start long, begins boolean, last boolean, ended boolean").persist()
    if (n := begun.count()) > MOST_SPLITS:
        raise QueryError("too_many_splits", f"The files have {n:,} splits; raise spark.sql.files.maxPartitionBytes to have {MOST_SPLITS:,} at most.")
    told = lines.join(F.broadcast(begun), ["key", "start"], "left").select("key", "start", "size", "value", "begins", "last", "ended")
    pieces = told.mapInArrow(_cut(grammars, whole), PIECES).persist()
    # a part belongs to the last record that opened before it
    opened = F.sum(F.when(F.col("kind") == OPENING, 1).otherwise(0)).over(Window.partitionBy("key").orderBy("start", "kind"))
    parts = pieces.where(F.col("kind") != WHOLE).withColumn("record", opened)
    mended = parts.groupBy("key", "record").applyInPandas(_joined(grammars, whole), "key string, start long, idx long, fields array<string>")
    return pieces.where(F.col("kind") == WHOLE).select("key", "start", "idx", "fields").union(mended), [begun, pieces]


def tokenize(text: str, separator: str) -> Iterator[list[str]]:
    """Records of a text that is at hand."""
    return grammar(separator, "\n").records(text.encode())
