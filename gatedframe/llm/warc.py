"""WARC archives of pages: written by Spark's text sink, read back, and put together capture by capture.

A capture is a request, a response (or a revisit of an equal payload) and a metadata record. Records of one capture
name each other in ``WARC-Concurrent-To``; assembly joins them through these identifiers to one nested row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatedframe.llm.storage import Scratch

#: Payloads shorter than this, in bytes, are never revisits.
MIN_REVISIT = 100
#: Captures in one archive file at most.
FILE_CAPTURES = 20_000
#: Fixed value of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
#: Records begin with this and a digit; the reader takes it as the separator of lines.
MARK = "WARC/1."

RECORD = "record_id string, kind string, concurrent_to array<string>, refers_to string, target_uri string, declared_digest string, page_id long, payload binary, payload_bytes long, payload_digest string"


def plan_records(pages: DataFrame, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(row, page_id, url, html, digest, first_row): first_row is the row whose payload a revisit repeats, else null.

    Of rows with equal payloads of ``min_revisit`` bytes or more, that with the smallest page_id is the response (a null id comes
    last, and of equal ids the first row). Rows are written to ``scratch`` with their numbers, since numbers given anew could differ.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    numbered = pages.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest")
    )
    rows = scratch.table(numbered, "rows")
    order = F.struct(F.col("page_id").isNull().alias("last"), F.col("page_id"), F.col("row"))
    firsts = rows.where(F.octet_length("html") >= min_revisit).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    # written, so that the rows of one very common payload can be dealt to several tasks
    firsts = scratch.table(firsts.select("digest", F.col("first.row").alias("first_row")), "firsts")
    joined = rows.join(firsts, "digest", "left")
    return joined.withColumn("first_row", F.when(F.col("first_row") != F.col("row"), F.col("first_row")))


def _urn(row: Column, kind: str) -> Column:
    """A record's identifier, made from its row and kind."""
    h = F.md5(F.concat(row.cast("string"), F.lit(f"/{kind}")))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(kind: str | Column, record_id: Column, mime: str, block: Column, headers: list[tuple[str, Column]]) -> Column:
    """One record. A header whose value is null is left out."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")))
    fixed = [("WARC-Type", F.lit(kind) if isinstance(kind, str) else kind), ("WARC-Record-ID", record_id), ("WARC-Date", F.lit(DATE))]
    tail = [("Content-Type", F.lit(mime)), ("Content-Length", F.octet_length(block).cast("string"))]
    return F.concat(F.lit(f"{MARK}1\r\n"), F.concat_ws("", *(line(n, v) for n, v in fixed + headers + tail)), F.lit("\r\n"), block, F.lit("\r\n\r\n"))


def write_archives(planned: DataFrame, path: str, captures: int = FILE_CAPTURES) -> None:
    """Three records for each row of ``plan_records``, as gzip archives with whole captures.

    The text sink ends a row with a line feed, which is the last byte of a record.
    """
    response = _urn(F.col("row"), "response")
    url = F.regexp_replace("url", r"[\r\n]+", "%0A")
    again = F.col("first_row").isNotNull()
    digest = F.concat(F.lit("sha256:"), F.col("digest"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), F.when(again, F.lit("")).otherwise(F.col("html")))
    request = _record("request", _urn(F.col("row"), "request"), "application/http; msgtype=request", F.concat(F.lit("GET "), F.coalesce(url, F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n")), [("WARC-Target-URI", url), ("WARC-Concurrent-To", response)])
    main = _record(
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")), response, "application/http; msgtype=response", http,
        [("WARC-Target-URI", url), ("WARC-Payload-Digest", digest), ("WARC-Refers-To", F.when(again, _urn(F.col("first_row"), "response"))), ("WARC-Profile", F.when(again, F.lit(REVISIT_PROFILE)))],
    )
    fields = F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit(""))
    metadata = _record("metadata", _urn(F.col("row"), "metadata"), "application/warc-fields", fields, [("WARC-Target-URI", url), ("WARC-Concurrent-To", response)])
    whole = F.concat(request, main, metadata)
    ended = planned.select(whole.alias("v")).select(F.expr("substring(v, 1, length(v) - 1)").alias("value"))
    ended.write.option("compression", "gzip").option("maxRecordsPerFile", captures).text(path)


def _headers(head: bytes) -> dict[str, list[str]]:
    found: dict[str, list[str]] = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            found.setdefault(name.decode("utf-8", "replace").strip().lower(), []).append(value.decode("utf-8", "replace").strip())
    return found


def record_length(text: bytes) -> int | None:
    """How long the record that ``text`` (without the mark) begins with is, without the blank lines behind it; None while its header isn't whole."""
    end = text.find(b"\r\n\r\n")
    if end < 0:
        return None
    length = (_headers(text[:end]).get("content-length") or ["0"])[0]
    return end + 4 + (int(length) if length.isdecimal() else 0)


def parse_record(text: bytes) -> dict:
    """The record that ``text`` (without the mark) begins with. Of a block cut off by the end of its archive there is what is left."""
    head, _, rest = text.partition(b"\r\n\r\n")
    headers = _headers(head)
    one = lambda name: (headers.get(name) or [None])[0]
    block = text[len(head) + 4 : record_length(text)]
    kind, mime = one("warc-type"), one("content-type") or ""
    payload = block.partition(b"\r\n\r\n")[2] if mime.startswith("application/http") else block
    page = None
    if kind == "metadata":
        ids = _headers(b"\r\n" + block).get("page-id")
        page = int(ids[0]) if ids else None
    return {
        "record_id": one("warc-record-id"), "kind": kind, "concurrent_to": headers.get("warc-concurrent-to", []), "refers_to": one("warc-refers-to"), "target_uri": one("warc-target-uri"),
        "declared_digest": one("warc-payload-digest"), "page_id": page, "payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest(),
    }


class _Joiner:
    """Puts the pieces between marks together to records, as a header or a block can hold the mark itself."""

    def __init__(self) -> None:
        self.held: list[bytes] = []
        self.size, self.needed, self.file = 0, None, None

    def add(self, file: str, piece: bytes) -> Iterator[dict]:
        if file != self.file:
            yield from self.end()
            self.file = file
        if not self.held and not piece:
            return
        self.size += len(piece) + len(MARK) * bool(self.held)
        self.held.append(piece)
        if self.needed is None:
            self.needed = record_length(MARK.encode().join(self.held))
        if self.needed is not None and self.size >= self.needed:
            yield from self.end()

    def end(self) -> Iterator[dict]:
        """The record so far; nothing where not even its header is whole."""
        if self.needed is not None:
            yield parse_record(MARK.encode().join(self.held))
        self.held, self.size, self.needed = [], 0, None


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives in a folder; columns as in ``RECORD``.

    An archive is read by one task from its start, as gzip demands. Where a header or a block itself holds the mark, the pieces are
    put together again until the header has ended and the block has its declared length.
    """
    lines = spark.read.option("lineSep", MARK).text(path).select(F.input_file_name().alias("file"), F.col("value").cast("binary").alias("value"))
    schema = pa.schema([(n, {"string": pa.string(), "array<string>": pa.list_(pa.string()), "long": pa.int64(), "binary": pa.binary()}[k]) for n, k in (c.split() for c in RECORD.split(", "))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joiner = _Joiner()
        for batch in batches:
            rows, size = [], 0
            for file, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for record in joiner.add(file, piece):
                    rows.append(record)
                    size += len(record["payload"])
                if size > 1 << 24:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
        if rows := list(joiner.end()):
            yield pa.RecordBatch.from_pylist(rows, schema)

    return lines.mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: (record_id, target_uri, response, request, metadata), the last three as nested records.

    Request and metadata records are joined to the response or revisit that they name, or that names them. A capture without
    one or the other has null there; of several of a kind, that with the smallest identifier is taken.
    """
    kinds = F.col("kind").isin("response", "revisit")
    main = records.where(kinds)
    named = main.select("record_id", F.explode("concurrent_to").alias("other"))

    def side(kind: str) -> DataFrame:
        own = records.where(F.col("kind") == kind)
        links = own.select(F.col("record_id").alias("other"), F.explode("concurrent_to").alias("record_id")).select("record_id", "other").union(named)
        body = F.struct(*(c for c in own.columns if c != "payload_digest")).alias(kind)
        met = links.distinct().join(own.withColumnRenamed("record_id", "other").withColumn("record_id", F.col("other")).select("other", body), "other")
        return met.groupBy("record_id").agg(F.min_by(kind, "other").alias(kind))

    return main.select("record_id", "target_uri", F.struct(*main.columns).alias("response")).join(side("request"), "record_id", "left").join(side("metadata"), "record_id", "left")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, from archives written and read back.

    A revisit's size and digest are those of the response that it refers to. A null html has an empty payload. Rows that repeat an id
    have captures of their own. An empty table gives an empty result and other columns are not read.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    write_archives(plan_records(pages, scratch, id_col, url_col, html_col), scratch.path("archives"))
    scratch.drop("rows", "firsts")
    # assembly reads the records several times; without payloads they are small, and archives are parsed once
    records = scratch.table(read_records(pages.sparkSession, scratch.path("archives")).drop("payload"), "records")
    scratch.drop("archives")
    captures = assemble(records)
    flat = scratch.table(
        captures.select("record_id", F.col("metadata.page_id").alias("page_id"), F.col("response.kind").alias("record_type"), F.col("response.refers_to").alias("target"),
                        F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest")), "captures",
    )
    scratch.drop("records")
    first = flat.where("record_type = 'response'").select(F.col("record_id").alias("target"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("d"))
    joined = flat.join(first, "target", "left")
    return joined.select("page_id", F.coalesce("b", "payload_bytes").alias("payload_bytes"), F.coalesce("d", "payload_digest").alias("payload_digest"), "record_type", "refers_to")
