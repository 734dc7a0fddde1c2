"""WARC archives: writing one gzip member per record, and a sequential reader.

Method: the reader goes through an archive once. It inflates one gzip member at a time, piece by piece,
takes the record's length from Content-Length, feeds the block to the digests as it comes, and checks
both digests and the frame at the member's end. At no time does it hold more than a chunk and a header,
or one payload where the caller wants payloads.

Records of equal payload of some size are stored once: the page with the largest id is a response, the
others revisit it. Archives go to the folder all executors share, under names of their own for every attempt of
a task; the list of archives holds only what finished tasks wrote, so a lost executor's files are never read.

Defined results: a null html is an empty payload. Pages with a null id are written and read with a null id
and can only revisit. Rows that repeat the largest id are all responses. Null urls leave the target out.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import cut_lineage, shared_folder

LEAST_SHARED = 1000  # bytes; smaller payloads are always stored
ARCHIVE = 256 << 20  # an archive is closed when it has so many bytes
CHUNK = 1 << 16
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class BrokenArchive(ValueError):
    """A frame or a digest that doesn't hold."""


# --- one record --------------------------------------------------------------------------


def _base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, level: int = LEVEL) -> bytes:
    """One gzip member: a response with its payload, or a revisit with the payload's length and digest alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {DATE}", f"WARC-Payload-Digest: {_base32(hashlib.sha1(payload).digest())}",
        f"WARC-Block-Digest: {_base32(hashlib.sha1(block).digest())}", "Content-Type: application/http;msgtype=response",
    ]
    if url is not None:
        fields.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if refers_to is not None:
        fields += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    fields.append(f"Content-Length: {len(block)}")
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    text = "\r\n".join(fields).encode() + b"\r\n\r\n"
    return squeeze.compress(text) + squeeze.compress(block) + squeeze.compress(b"\r\n\r\n") + squeeze.flush()


@dataclass
class Record:
    kind: str
    page_id: int | None
    target: str | None
    refers_to: int | None
    payload_bytes: int
    payload_digest: str  # bare hexadecimal SHA-1
    payload: bytes | None


class _Frame:
    """Takes the bytes of one record in any pieces; holds its header and running digests."""

    def __init__(self, with_payload: bool):
        self.head, self.fields, self.http = bytearray(), None, None
        self.left, self.tail, self.seen = 0, bytearray(), 0
        self.block, self.body = hashlib.sha1(), hashlib.sha1()
        self.payload = bytearray() if with_payload else None

    def feed(self, data: bytes) -> None:
        if self.fields is None:
            self.head += data
            end = self.head.find(b"\r\n\r\n")
            if end < 0:
                return
            lines = bytes(self.head[:end]).decode("utf-8").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise BrokenArchive("no record begins here")
            self.fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
            self.left = int(self.fields["content-length"])
            data = bytes(self.head[end + 4 :])
            self.head = bytearray()
        part, rest = data[: self.left], data[self.left :]
        self.left -= len(part)
        self.block.update(part)
        if self.http is None:
            self.head += part
            end = self.head.find(b"\r\n\r\n")
            if end >= 0:
                lines = bytes(self.head[:end]).decode("latin-1").split("\r\n")
                self.http = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
                self._take(bytes(self.head[end + 4 :]))
        else:
            self._take(part)
        self.tail += rest

    def _take(self, data: bytes) -> None:
        self.seen += len(data)
        self.body.update(data)
        if self.payload is not None:
            self.payload += data

    def done(self) -> Record:
        f = self.fields
        if f is None or self.left or self.http is None or bytes(self.tail) != b"\r\n\r\n":
            raise BrokenArchive("a record's length and its content differ")
        if f["warc-block-digest"] != _base32(self.block.digest()):
            raise BrokenArchive("block digest")
        length, whole = int(self.http["content-length"]), f["warc-type"] == "response"
        if whole and (self.seen != length or f["warc-payload-digest"] != _base32(self.body.digest())):
            raise BrokenArchive("payload digest")
        digest = base64.b32decode(f["warc-payload-digest"].removeprefix("sha1:")).hex()
        payload = bytes(self.payload) if whole and self.payload is not None else None
        return Record(f["warc-type"], _page(f["warc-record-id"]), f.get("warc-target-uri"), _page(f.get("warc-refers-to")), length, digest, payload)


def _page(name: str | None) -> int | None:
    number = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number not in ("", "None") else None


def records(read: Callable[[int], bytes], with_payload: bool = False) -> Iterator[Record]:
    """The records of an archive in order; ``read(n)`` gives the next bytes, none at the end."""
    inflate, frame = zlib.decompressobj(31), _Frame(with_payload)
    begun = False
    while data := read(CHUNK):
        while data:
            begun = True
            out = inflate.decompress(data, CHUNK)
            if out:
                frame.feed(out)
            data = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
            if inflate.eof:
                yield frame.done()
                inflate, frame, begun = zlib.decompressobj(31), _Frame(with_payload), False
    while begun and not inflate.eof:  # what the last bytes still hold
        out = inflate.decompress(b"", CHUNK)
        if not out:
            raise BrokenArchive("the archive ends inside a record")
        frame.feed(out)
    if begun:
        yield frame.done()


# --- tables ------------------------------------------------------------------------------


def with_revisits(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """(page_id, url, html, refers_to): the page that holds an equal payload of at least ``least`` bytes, if it is another.

    Groups are found on (id, digest, size). Only rows that revisit meet the pages again, by their unique
    id, so a payload that a third of all pages share doesn't gather those pages' texts anywhere.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    digest = F.when(F.octet_length(payload) >= least, F.sha2(payload, 256)).alias("digest")
    narrow = cut_lineage(pages.select("page_id", digest).filter(F.col("digest").isNotNull()))
    holders = narrow.groupBy("digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("n"))
    holders = cut_lineage(holders.filter("n > 1 AND holder IS NOT NULL").select("digest", "holder"))
    again = narrow.join(holders, "digest").filter("page_id IS NULL OR page_id <> holder").distinct()
    again = cut_lineage(again.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), F.col("holder").alias("refers_to")))
    held = pages.select("page_id", "url", "html", digest)
    met = held.join(again, held["page_id"].eqNullSafe(again["_id"]) & (held["digest"] == again["_digest"]), "left")
    return met.select("page_id", "url", "html", "refers_to")


ARCHIVES = T.StructType([T.StructField("path", T.StringType()), T.StructField("n_records", T.LongType())])


def write_archives(pages: DataFrame, folder: str, archive: int = ARCHIVE, level: int = LEVEL) -> DataFrame:
    """Write (page_id, url, html, refers_to) as WARC archives below ``folder``; the table of archives written.

    ``folder`` is any place that pyarrow's file systems open: file, hdfs, s3, gs, abfs.
    """
    schema = to_arrow_schema(ARCHIVES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        made, out, count, size = [], None, 0, 0
        for batch in batches:
            for row in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                if out is None:
                    path, count, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(path, compression=None)
                data = record(row[0], row[1], (row[2] or "").encode("utf-8", "replace"), row[3], level)
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= archive:
                    out.close()
                    made.append((path, count))
                    out = None
        if out is not None:
            out.close()
            made.append((path, count))
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], schema=schema)

    # written down at once: a list that is worked out again would name other files
    return cut_lineage(pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, ARCHIVES))


READ = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()),
    T.StructField("target", T.StringType()), T.StructField("payload", T.BinaryType()),
])


def read_archives(archives: DataFrame, folder: str, with_payload: bool = False, rows: int = 2000) -> DataFrame:
    """One row per record of the archives listed, every archive read by one task from front to back."""
    schema = T.StructType(READ.fields[: len(READ.fields) - (not with_payload)])
    arrow = to_arrow_schema(schema)

    def batch_of(held: list[Record]) -> pa.RecordBatch:
        columns = [[r.page_id for r in held], [r.payload_bytes for r in held], [r.payload_digest for r in held], [r.kind for r in held],
                   [r.refers_to for r in held], [r.target for r in held], [r.payload for r in held]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=False)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with files.open_input_stream(path, compression=None) as stream:
                    held: list[Record] = []
                    for r in records(stream.read, with_payload):
                        held.append(r)
                        if len(held) >= rows:
                            yield batch_of(held)
                            held = []
                    if held:
                        yield batch_of(held)

    n = max(1, archives.count())
    return archives.select("path").repartition(n).mapInArrow(run, schema)


def round_trip(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """Write the pages as archives in the shared folder, and read them back."""
    folder = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(with_revisits(pages, least), folder), folder)
