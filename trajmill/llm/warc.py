"""WARC archives compressed record by record with a Zstandard dictionary that the archive carries.

An archive (`.warc.zst`) begins with a skippable frame of magic 0x184D2A5D that holds the dictionary (itself compressed);
then every record is one Zstandard frame, readable alone with it. The dictionary is trained on the archive's own first
records, a bounded sample (SAMPLE_BYTES), whose order is that of a hash. An archive whose records are too few to train on
has no dictionary frame. A payload that came before is archived as a `revisit` of its `response`, without a body; the
length and digest that its headers name are those of the full payload.

The payloads of large responses are shuffled once, equal ones meet before that in each task, and the writers run on the
shuffled partitions, so archives have the size of those but at most ARCHIVE_BYTES (and one record) before compression. A writer puts each archive under a
new name and moves it there when it is complete; archives count only if the manifest, a table written from the results of
the tasks that succeeded, names them, so lost executors and repeated tasks leave nothing but unnamed files.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajmill.llm.common import shared_folder, tidy, written

#: Fixed values of the formats.
MAGIC, ZSTD_MAGIC, VERSION = 0x184D2A5D, b"\x28\xb5\x2f\xfd", "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: What a URL may not hold and a header could not: percent-encoded there.
CONTROL = re.compile(r"[\x00-\x20\x7f\x85\u2028\u2029]")
#: Payloads below this length are archived each time.
LEAST_SHARED = 100
#: Bytes of records in an archive, of a dictionary, and of the records that it is trained on (of one record at most the last).
ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLE_BYTES, RECORD_SAMPLE = 256 << 20, 64 << 10, 4 << 20, 64 << 10
LEVEL = 6
#: Copies of a repeated row that stay together, and about as many short records as a task writes.
COPIES, TASK_RECORDS = 4096, 200_000

MANIFEST = "path string, records bigint, bytes bigint, dictionary bigint"
RECORD = "archive string, offset bigint, record_id string, type string, uri string, page_id bigint, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


# --- records ---------------------------------------------------------------------------------------------------------


def _block(headers: list[tuple[str, str]], body: bytes) -> bytes:
    lines = "".join(f"{name}: {value}\r\n" for name, value in [*headers, ("Content-Length", str(len(body)))])
    return f"{VERSION}\r\n{lines}\r\n".encode() + body + b"\r\n\r\n"


def _urn(*of: object) -> str:
    return f"<{uuid.UUID(bytes=hashlib.sha256(repr(of).encode()).digest()[:16], version=4).urn}>"


def record(kind: str, page_id: int | None, url: str | None, copy: int, digest: str, length: int, payload: bytes, date: str, first: tuple[int | None, str | None] | None = None) -> bytes:
    """A response with its payload, or a revisit (of `first`: page_id, url) with the headers alone."""
    place = lambda u: CONTROL.sub(lambda m: quote(m[0]), u)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    headers = [("WARC-Type", kind), ("WARC-Record-ID", _urn(page_id, url, copy, digest)), ("WARC-Date", date)]
    headers += [("WARC-Target-URI", place(url))] if url is not None else []
    headers += [("X-Page-Id", str(page_id))] if page_id is not None else []
    headers += [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if first is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(*first, 0, digest))]
        headers += [("WARC-Refers-To-Target-URI", place(first[1]))] if first[1] is not None else []
        headers += [("X-Refers-To-Page-Id", str(first[0]))] if first[0] is not None else []
    return _block(headers, http + payload)


def parse(data: bytes) -> dict:
    """Headers (names in lower case) and body of a record; an error if it is not whole."""
    head, split, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not split or not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {name.lower(): value for name, _, value in (line.partition(": ") for line in lines)}
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"record of {len(rest)} bytes, {length + 4} expected")
    return {"headers": headers, "body": rest[:length]}


# --- archives --------------------------------------------------------------------------------------------------------


class Writer:
    """One archive: the first records wait until there are SAMPLE_BYTES of them (or the archive ends) to train the dictionary on."""

    def __init__(self, out: BinaryIO, date: str):
        self.out, self.date, self.waiting, self.waiting_bytes = out, date, [], 0
        self.records = self.bytes = self.dictionary = 0
        self.compress = None

    def add(self, data: bytes) -> None:
        self.records, self.bytes = self.records + 1, self.bytes + len(data)
        if self.compress is not None:
            self.out.write(self.compress(data))
            return
        self.waiting.append(data)
        self.waiting_bytes += len(data)
        if self.waiting_bytes >= SAMPLE_BYTES:
            self._start()

    def _start(self) -> None:
        options = {"level": LEVEL, "write_checksum": True, "write_content_size": True}
        try:
            trained = zstandard.train_dictionary(min(DICTIONARY_BYTES, self.waiting_bytes // 8), [r[:RECORD_SAMPLE] for r in self.waiting], level=LEVEL)
        except zstandard.ZstdError:  # too few records, or too short ones
            trained = None
        if trained is not None:
            packed = zstandard.ZstdCompressor(level=LEVEL).compress(trained.as_bytes())
            self.dictionary = len(trained.as_bytes())
            self.out.write(struct.pack("<II", MAGIC, len(packed)) + packed)
            options["dict_data"] = trained
        self.compress = zstandard.ZstdCompressor(**options).compress
        info = b"software: trajmill\r\nformat: WARC File Format 1.1\r\n"
        self.out.write(self.compress(_block([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _urn("info", self.waiting[0] if self.waiting else b"")), ("WARC-Date", self.date), ("Content-Type", "application/warc-fields")], info)))
        for data in self.waiting:
            self.out.write(self.compress(data))
        self.waiting = []

    def end(self) -> None:
        if self.compress is None:
            self._start()


def frames(source: BinaryIO, size: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of every frame of an archive; memory holds one record and `size` bytes."""
    data, at, options = source.read(size), 0, {}
    if len(data) >= 8 and struct.unpack("<I", data[:4])[0] == MAGIC:
        length = struct.unpack("<I", data[4:8])[0]
        while len(data) < 8 + length:
            if not (more := source.read(max(size, 8 + length - len(data)))):
                raise ValueError("an archive ends within its dictionary")
            data += more
        held, data, at = data[8 : 8 + length], data[8 + length :], 8 + length
        held = zstandard.ZstdDecompressor().decompress(held) if held.startswith(ZSTD_MAGIC) else held
        options["dict_data"] = zstandard.ZstdCompressionDict(held)
    reader = zstandard.ZstdDecompressor(**options)
    while data or (data := source.read(size)):
        one, out, begin = reader.decompressobj(), [], at
        while True:
            out.append(one.decompress(data))
            at += len(data)
            if one.eof:
                data = one.unused_data
                at -= len(data)
                break
            if not (data := source.read(size)):
                raise ValueError("an archive ends within a record")
        yield begin, b"".join(out)


def _open(path: str) -> BinaryIO:
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_stream(inner, compression=None)


def _archived(records: DataFrame, folder: str, date: str, archive_bytes: int) -> DataFrame:
    """The manifest (lazy) of records (kind, page_id, url, copy, digest, length, payload, first), an archive or more for each partition that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(folder)
        system.create_dir(top, recursive=True)
        name, out = "", None

        def closed() -> pa.RecordBatch:
            out.end()
            out.out.close()
            system.move(f"{top}/{name}.part", f"{top}/{name}.warc.zst")
            return pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}.warc.zst", "records": out.records, "bytes": out.bytes, "dictionary": out.dictionary}])

        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(k)[i].as_py() for k, c in enumerate(batch.schema.names)}
                if out is None:
                    name = uuid.uuid4().hex
                    out = Writer(system.open_output_stream(f"{top}/{name}.part", compression=None), date)
                first = (row["first"]["page_id"], row["first"]["url"]) if row["first"] is not None else None
                out.add(record(row["kind"], row["page_id"], row["url"], row["copy"], row["digest"], row["length"], row["payload"] or b"", date, first))
                if out.bytes >= archive_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()
        tidy()

    return records.select("kind", "page_id", "url", "copy", "digest", "length", "payload", "first").mapInArrow(run, MANIFEST)


def _order(page_id: str = "page_id", url: str = "url") -> list[Column]:
    """Smallest first, nulls last."""
    return [F.col(page_id).isNull().alias("no_id"), F.col(page_id).alias("page_id"), F.col(url).isNull().alias("no_url"), F.col(url).alias("url")]


def write_warc(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives every row of pages (page_id, url, html) under `folder`; returns the manifest, a written table
    (path, records, bytes before compression, bytes of the dictionary).

    A null html is an empty payload, white space and control characters in a url are percent-encoded. Of rows with equal payloads of LEAST_SHARED bytes or more that with the smallest
    (page_id, url) is the response, a null page_id or url being the largest; of rows equal in both and in the payload one.
    """
    html = F.coalesce("html", F.lit(""))
    length = F.octet_length(html).cast("bigint")
    own = pages.select("page_id", "url", html.alias("html"), length.alias("length"), F.sha2(html, 256).alias("digest"))
    small = F.when(F.col("length") < LEAST_SHARED, F.encode("html", "UTF-8")).alias("payload")
    narrow = written(own.select("page_id", "url", "digest", "length", small).groupBy("page_id", "url", "digest", "length", "payload").agg(F.count("*").alias("n")))

    # the response of each large payload; equal payloads meet in each task before they are shuffled
    firsts = own.where(F.col("length") >= LEAST_SHARED).groupBy("digest").agg(F.min(F.struct(*_order())).alias("who"), F.first("html").alias("html"), F.first("length").alias("length"))
    none = F.lit(None).cast("struct<page_id:bigint,url:string>").alias("first")
    responses = firsts.select(F.lit("response").alias("kind"), "who.page_id", "who.url", F.lit(0).cast("bigint").alias("copy"), "digest", "length", F.encode("html", "UTF-8").alias("payload"), none)

    # everything else is short: copies without a body, and small payloads
    large = narrow.where(F.col("length") >= LEAST_SHARED)
    shared = written(large.groupBy("digest").agg(F.min(F.struct(*_order())).alias("who"), F.sum("n").alias("rows")).where("rows > 1"))
    at_first = F.col("page_id").eqNullSafe(F.col("who.page_id")) & F.col("url").eqNullSafe(F.col("who.url"))
    copies = large.join(shared.select("digest", "who"), "digest").withColumn("from", F.when(at_first, 1).otherwise(0).cast("bigint"))
    copies = copies.select(F.lit("revisit").alias("kind"), "page_id", "url", "from", "n", "digest", "length", "payload", F.struct("who.page_id", "who.url").alias("first"))
    alone = narrow.where(F.col("length") < LEAST_SHARED).select(F.lit("response").alias("kind"), "page_id", "url", F.lit(0).cast("bigint").alias("from"), "n", "digest", "length", "payload", none)
    runs = copies.unionByName(alone).where(F.col("from") < F.col("n")).withColumn("at", F.explode(F.sequence("from", F.col("n") - 1, F.lit(COPIES).cast("bigint"))))
    rows = narrow.agg(F.sum("n")).first()[0] or 0
    runs = runs.repartition(rows // TASK_RECORDS + 1, "page_id", "url", "digest", "at")
    rest = runs.withColumn("copy", F.explode(F.sequence("at", F.least(F.col("at") + COPIES, F.col("n")) - 1)))

    return written(_archived(responses, folder, date, archive_bytes).unionByName(_archived(rest, folder, date, archive_bytes)))


def read_warc(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records (RECORD) of the archives that `manifest` (path) names, information records left out.

    Length and digest of a response are taken from its body, and an error is raised where the headers say otherwise; those
    of a revisit are the headers'. `payloads`: whether bodies are returned (else null).
    """
    schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("record_id", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def rows(path: str) -> Iterator[dict]:
        with _open(path) as source:
            for offset, data in frames(source):
                whole = parse(data)
                headers, (http, _, payload) = whole["headers"], whole["body"].partition(b"\r\n\r\n")
                if (kind := headers["warc-type"]) == "warcinfo":
                    continue
                fields = dict(line.partition(": ")[::2] for line in http.decode().split("\r\n")[1:])
                length, digest = int(fields["Content-Length"]), headers["warc-payload-digest"].removeprefix("sha256:")
                if kind == "response" and (length, digest) != (found := (len(payload), hashlib.sha256(payload).hexdigest())):
                    raise ValueError(f"{path}, {offset}: the headers say {(length, digest)}, the payload is {found}")
                number = lambda name: int(headers[name]) if name in headers else None
                yield {
                    "archive": path, "offset": offset, "record_id": headers["warc-record-id"], "type": kind, "uri": headers.get("warc-target-uri"), "page_id": number("x-page-id"), "refers_to": number("x-refers-to-page-id"),
                    "payload_bytes": length, "payload_digest": digest, "payload": payload if payloads and kind == "response" else None,
                }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                some, size = [], 0
                for row in rows(path):
                    some.append(row)
                    size += 512 + len(row["payload"] or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(some, schema)
                        some, size = [], 0
                if some:
                    yield pa.RecordBatch.from_pylist(some, schema)
        tidy()

    n = max(1, min(manifest.count(), 100_000))
    return manifest.select("path").repartition(n).mapInArrow(run, RECORD)


def archive_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Pages written to archives in the shared folder and read back: a record's length, digest, type and what it refers to.

    Every row has one record: see `write_warc` for nulls, ties and repeated rows (of fully equal ones, one is the response and
    the others revisit it, by its own page_id). Very long payloads are one record each. Other columns are ignored. No rows: no rows.
    """
    manifest = write_warc(pages, f"{shared_folder(spark)}/archives/{uuid.uuid4().hex}")
    return read_warc(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


ORACLE = """WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, url, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, url NULLS LAST) AS n, first_value(page_id) OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, url NULLS LAST) AS first FROM s)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes < 100 OR n = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN payload_bytes >= 100 AND n > 1 THEN first END AS refers_to FROM r"""
