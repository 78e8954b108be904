"""WARC archives as a table of chunks.

Writing: each page becomes rows of at most ``chunk`` payload bytes, in order: a head (WARC and HTTP headers), one row
for each chunk of an HTTP chunked body, an end. Tasks yield them one after the other out of the page's cell, which is read
as it stands and never copied as a whole; what is a copy of what is found out from identifiers and digests alone. Spark's text writer joins them by CRLF, which is just what the chunked
coding puts between them, so the files are plain WARC/1.1 (gzip), on any storage that Spark writes to.

Reading: files are read line by line; a line is never longer than a chunk. Rows (record, chunk number, bytes, running
digest, length so far) stream out while SHA-256 goes on from chunk to chunk; no record is ever held as a whole.

Of records with equal payloads of at least ``least`` bytes the one with the smallest page_id is the response, others
revisit it and carry no payload but its digest and length. Rows that repeat the smallest page_id are all responses; so
are pages without a page_id when no page with that payload has one. Null payloads are empty.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkscore.llm.links import bounded
from inkscore.session import materialise, scratch_path

HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
CHUNKED = "Transfer-Encoding: chunked\r\n"
HELD = 8 << 20  # bytes of rows that a task holds before it hands them on
RECORD_CHUNKS = (
    "page_id bigint, record_type string, refers_to bigint, chunk int, payload binary, sha256 string, bytes bigint, last boolean, declared string, declared_bytes bigint"
)


def with_origin(pages: DataFrame, least: int = 100) -> DataFrame:
    """(page_id, url, digest, origin, body): ``origin`` is the page that a revisit refers to, else null.

    Only rows of identifiers and digests meet. The revisits among them are sent to the pages' own tasks up to the bound of
    ``links.bounded``; beyond it pages travel by identifier and digest, so equal payloads do not meet in one task.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.sha2(body, 256).alias("digest"), body.alias("body"))
    long = materialise(rows.filter(F.length("body") >= least).select("page_id", "digest"), "digests")
    first = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select("digest", "first")
    again = long.join(bounded(materialise(first, "repeated")), "digest").filter(~F.col("page_id").eqNullSafe(F.col("first")))
    again = again.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), F.col("first").alias("origin")).distinct()
    met = rows.join(bounded(materialise(again, "revisits")), F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")
    return met.select("page_id", "url", "digest", "origin", "body")


def record_rows(page_id: int | None, url: str | None, digest: str, origin: int | None, body: memoryview, chunk: int) -> Iterator[bytes]:
    """The rows of one record; CRLF follows every row: the last one of the HTTP headers, of each chunk and of the record is the writer's."""
    size, again = len(body), origin is not None
    if again:
        http = f"{HTTP}Content-Length: {size}\r\n"
        length = len(http) + 2
    else:
        http = HTTP + CHUNKED
        framed = [len(f"{n:x}") + 4 + n for n in (chunk, size % chunk)]
        length = len(http) + 2 + size // chunk * framed[0] + (framed[1] if size % chunk else 0) + 5
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if again else 'response'}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:  # header values hold no line breaks or control characters
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7F]", "%20", url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if again:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{origin}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {length}", "", http]
    yield "\r\n".join(head).encode()
    if not again:
        for at in range(0, size, chunk):
            part = body[at : at + chunk]
            yield b"".join((f"{len(part):x}\r\n".encode(), part))
        yield b"0\r\n"
    yield b"\r\n"


def write_archives(pages: DataFrame, path: str, chunk: int = 1 << 20, least: int = 100) -> None:
    """Writes ``pages`` as gzip WARC files, one for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [batch.column(k).to_pylist() for k in range(4)]
            held, size = [], 0
            for *name, body in zip(*names, batch.column(4), strict=True):
                for row in record_rows(*name, memoryview(body.as_buffer()), chunk):
                    held.append(row)
                    size += len(row)
                    if size > HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])
                        held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])

    rows = with_origin(pages, least).mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    rows.write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


class _Reader:
    """Follows the lines of archives and turns payload bytes into chunk rows; holds one chunk at most."""

    def __init__(self, chunk: int):
        self.chunk = chunk
        self.rows: list[tuple] = []
        self.state = "skip"

    def line(self, text: bytes) -> None:
        """One line without its line feed."""
        getattr(self, "_" + self.state)(text)

    def _skip(self, text: bytes) -> None:
        if text.startswith(b"WARC/"):
            self.state, self.warc = "headers", {}

    def _headers(self, text: bytes) -> None:
        text = text.rstrip(b"\r")
        if text:
            key, _, value = text.partition(b":")
            self.warc[key.lower()] = value.strip().decode()
            return
        self.left = int(self.warc[b"content-length"])
        self.state, self.http = ("http", {}) if self.left else ("skip", {})

    def _http(self, text: bytes) -> None:
        self.left -= len(text) + 1
        text = text.rstrip(b"\r")
        if text:
            key, _, value = text.partition(b":")
            self.http[key.lower()] = value.strip().decode()
            return
        self.number, self.total, self.digest = 0, 0, hashlib.sha256()
        if self.http.get(b"transfer-encoding") == "chunked":
            self.state = "size"
        else:  # a revisit: headers only
            self._end()

    def _size(self, text: bytes) -> None:
        self.wanted = int(text.split(b";")[0], 16)
        self.parts: list[bytes] = []
        self.state = "data" if self.wanted else "trailer"

    def _data(self, text: bytes) -> None:
        text += b"\n"
        if len(text) < self.wanted:
            self.parts.append(text)
            self.wanted -= len(text)
            return
        self.parts.append(text[: self.wanted])  # CRLF follows the chunk: in this line, or the next if the chunk ends with LF
        if len(text) == self.wanted:
            self.state = "gap"
        else:
            self.state = "size"
        self._row(b"".join(self.parts), False)

    def _gap(self, text: bytes) -> None:
        self.state = "size"

    def _trailer(self, text: bytes) -> None:
        if not text.rstrip(b"\r"):
            self._end()

    def _end(self) -> None:
        self.state = "skip"
        self._row(b"", True)

    def _row(self, payload: bytes, last: bool) -> None:
        self.digest.update(payload)
        self.total += len(payload)
        name = re.fullmatch(r"<urn:page:(-?\d+)>", self.warc.get(b"warc-record-id", ""))
        origin = re.fullmatch(r"<urn:page:(-?\d+)>", self.warc.get(b"warc-refers-to", ""))
        length = self.http.get(b"content-length")
        self.rows.append(
            (
                int(name[1]) if name else None,
                self.warc.get(b"warc-type"),
                int(origin[1]) if origin else None,
                self.number,
                payload,
                self.digest.copy().hexdigest(),
                self.total,
                last,
                self.warc.get(b"warc-payload-digest", "").removeprefix("sha256:"),
                int(length) if length else None,
            )
        )
        self.number += 1


def read_chunks(spark: SparkSession, path: str, chunk: int = 1 << 20) -> DataFrame:
    """The chunk table of the archives at ``path``; each record ends with an empty row marked ``last``."""
    names = [x.split()[0] for x in RECORD_CHUNKS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(chunk)

        def out() -> pa.RecordBatch:
            columns = list(zip(*reader.rows, strict=True)) if reader.rows else [()] * len(names)
            reader.rows, held = [], [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(held, names)

        for batch in batches:
            size = 0
            for text in batch.column(0):
                text = text.as_py()
                reader.line(text)
                size += len(text)
                if size > HELD:
                    yield out()
                    size = 0
            yield out()

    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("value"))
    return lines.mapInArrow(run, RECORD_CHUNKS)


def archived(pages: DataFrame, chunk: int = 1 << 20, least: int = 100) -> DataFrame:
    """Writes the pages and reads them back: one row for each record, from the last row of its chunks."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, chunk, least)
    last = read_chunks(pages.sparkSession, path, chunk).filter("last")
    again = F.col("record_type") == "revisit"
    whole = F.when(again, F.col("declared")).when(F.col("sha256") == F.col("declared"), F.col("sha256"))
    return last.select(
        "page_id",
        F.when(again, F.col("declared_bytes")).otherwise(F.col("bytes")).alias("payload_bytes"),
        F.coalesce(whole, F.raise_error(F.lit("payload and digest differ"))).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
