"""WARC archives: a writer of one gzip member per record, and a sequential reader that verifies them.

The reader takes a byte stream in chunks. It inflates one gzip member after another with an incremental zlib
decompressor, frames each record by its Content-Length, and checks block and payload digests; nothing is
loaded whole but one record. A truncated member, a wrong frame or a wrong digest raises.

Archives are files in a shared folder, written by the tasks that hold the pages and read back by others. A
task writes under a name of its own and gives the name as a row once the file is whole, so a lost executor
leaves at most a file that no row names.
"""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import new_path, stored

#: Compressed bytes read at once; what is left of them after a member is copied.
CHUNK = 1 << 14
#: Payload bytes of a batch of records read.
BATCH_BYTES = 8 << 20
#: Uncompressed bytes after which a new archive is begun.
ARCHIVE_BYTES = 64 << 20
#: Tasks that read archives back, at most; each takes its archives one after another.
READERS = 100_000
#: Payloads of fewer bytes are never revisits.
MIN_BYTES = 0
DATE = "2000-01-01T00:00:00Z"
_RESPONSE_TYPE = "application/http; msgtype=response"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class BrokenArchive(ValueError):
    """The archive doesn't follow the format, or a digest doesn't match."""


@dataclass
class Record:
    kind: str
    block: bytes
    headers: list[tuple[str, str]] = field(default_factory=list)

    def get(self, name: str) -> str | None:
        """The first value of a header, whose name may be in any case."""
        return next((v for k, v in self.headers if k.lower() == name.lower()), None)


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def member(record: Record) -> bytes:
    """The record as one gzip member."""
    head = [("WARC-Type", record.kind), *record.headers, ("WARC-Block-Digest", f"sha1:{digest(record.block)}"), ("Content-Length", str(len(record.block)))]
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in head], "", ""]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(lines).encode()) + deflate.compress(record.block) + deflate.compress(b"\r\n\r\n") + deflate.flush()


def http_block(payload: bytes, with_payload: bool) -> bytes:
    """An HTTP response; for a revisit only its head, which still tells the payload's length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return head + payload if with_payload else head


def http_parts(block: bytes) -> tuple[dict[str, str], bytes]:
    head, found, payload = block.partition(b"\r\n\r\n")
    if not found:
        raise BrokenArchive("an HTTP head doesn't end")
    lines = head.decode("latin-1").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}, payload


def _parse(data: bytes) -> Record:
    head, found, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not found or not first.startswith("WARC/1."):
        raise BrokenArchive("a record has no WARC head")
    headers = [(k.strip(), v.strip()) for k, _, v in (line.partition(":") for line in lines)]
    record = Record("", b"", headers)
    length = record.get("Content-Length") or ""
    if not length.isdigit() or rest[int(length) :] != b"\r\n\r\n":
        raise BrokenArchive("Content-Length doesn't frame the block")
    record.kind, record.block = record.get("WARC-Type") or "", rest[: int(length)]
    told = record.get("WARC-Block-Digest")
    if told and told.removeprefix("sha1:") != digest(record.block):
        raise BrokenArchive("the block digest doesn't match")
    if record.kind == "response" and (told := record.get("WARC-Payload-Digest")) and told.removeprefix("sha1:") != digest(http_parts(record.block)[1]):
        raise BrokenArchive("the payload digest doesn't match")
    return record


def read_records(stream: BinaryIO, chunk: int = CHUNK) -> Iterator[Record]:
    """The records of an archive in order; holds one record and one chunk at a time."""
    data = stream.read(chunk)
    while data:
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if not data:
                raise BrokenArchive("a gzip member is cut off")
            try:
                parts.append(inflate.decompress(data))
            except zlib.error as e:
                raise BrokenArchive(f"not a gzip member: {e}") from e
            data = inflate.unused_data if inflate.eof else stream.read(chunk)
        yield _parse(b"".join(parts))
        data = data or stream.read(chunk)


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it; s3a is read as s3."""
    return fs.FileSystem.from_uri("s3://" + uri.removeprefix("s3a://") if uri.startswith("s3a://") else uri)


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row (page_id, url, html, digest, refers_to) under folder; a row (path, n_records) per archive.

    A row with refers_to is written as revisit of that page, another as response. Each archive begins with a
    warcinfo record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_system(folder)
        store.create_dir(base, recursive=True)
        out, path, size, n = None, "", 0, 0
        done: list[tuple[str, int]] = []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path, size, n = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                    info = [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")]
                    out.write(member(Record("warcinfo", b"format: WARC File Format 1.1\r\n", info)))
                payload = (row["html"] or "").encode()
                revisit = row["refers_to"] is not None
                headers = [
                    ("WARC-Record-ID", f"<urn:page:{row['page_id']}>"),
                    ("WARC-Date", DATE),
                    ("WARC-Target-URI", urllib.parse.quote(row["url"] or "", safe=":/?#[]@!$&'()*+,;=%-._~")),
                    ("Content-Type", _RESPONSE_TYPE),
                    ("WARC-Payload-Digest", f"sha1:{row['digest']}"),
                ]
                if revisit:
                    headers += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<urn:page:{row['refers_to']}>")]
                data = member(Record("revisit" if revisit else "response", http_block(payload, not revisit), headers))
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= archive_bytes:
                    out.close()
                    done.append((path, n))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n))
        prefix = folder[: -len(base)] if folder.endswith(base) else ""
        yield pa.RecordBatch.from_arrays([pa.array([prefix + p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["path", "n_records"])

    return rows.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "path string, n_records long")


def read_archives(archives: DataFrame) -> DataFrame:
    """The response and revisit records of the archives (path): page_id, url, payload_bytes, payload_digest, record_type, refers_to, html.

    html is the payload of a response and null for a revisit; payload_bytes and payload_digest are those of the
    full payload in both cases (a revisit keeps the HTTP head). Archives go to tasks one by one.
    """

    def page(urn: str | None) -> int | None:
        value = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return None if value in ("", "None") else int(value)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"]

        def frame(rows: list[tuple]) -> pd.DataFrame:
            pdf = pd.DataFrame(rows, columns=names)
            return pdf.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})

        for paths in batches:
            for path in paths["path"]:
                store, base = file_system(path)
                rows, size = [], 0
                with store.open_input_stream(base, compression=None) as stream:
                    for r in read_records(stream):
                        if r.kind not in ("response", "revisit"):
                            continue
                        http, payload = http_parts(r.block)
                        full = int(http["content-length"])
                        if r.kind == "response" and full != len(payload):
                            raise BrokenArchive("the HTTP Content-Length doesn't match")
                        rows.append((page(r.get("WARC-Record-ID")), r.get("WARC-Target-URI"), full, (r.get("WARC-Payload-Digest") or "").removeprefix("sha1:"), r.kind, page(r.get("WARC-Refers-To")), payload.decode() if r.kind == "response" else None))
                        size += len(payload)
                        if size > BATCH_BYTES:
                            yield frame(rows)
                            rows, size = [], 0
                if rows:
                    yield frame(rows)

    return archives.select("path").mapInPandas(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string")


def base32(hexadecimal: Column) -> Column:
    """Base32 of 40 hexadecimal digits: each 5 of them are 4 characters."""
    letter = lambda v, right: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.shiftright(v, right).bitwiseAND(31) + 1, F.lit(1))
    parts = [F.conv(F.substring(hexadecimal, 5 * i + 1, 5), 16, 10).cast("int") for i in range(8)]
    return F.concat(*[letter(v, right) for v in parts for right in (15, 10, 5, 0)])


def archive_pages(pages: DataFrame, min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a WARC record per row of pages (page_id long, url, html), then read all archives back; see read_archives.

    Of rows with equal payloads of at least min_bytes bytes, those with the smallest page_id are responses and
    the others revisit it; smaller payloads are all responses. A null html is an empty payload, a null url an
    empty URI; a row with a null page_id is a response where no equal payload has an id, else a revisit. Rows
    that repeat a page_id get a record each. Other columns are ignored; an empty table gives no row.
    """
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", "html", F.sha1(F.coalesce(F.col("html").cast("binary"), F.lit(b""))).alias("sha1"))
    sized = rows.select("page_id", "sha1", F.coalesce(F.octet_length("html"), F.lit(0)).alias("n"))
    first = sized.filter(F.col("n") >= min_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).filter("c > 1 AND first IS NOT NULL").select("sha1", "first")
    linked = rows.join(first, "sha1", "left").withColumn("refers_to", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")))
    archives = stored(write_archives(linked.withColumn("digest", base32(F.col("sha1"))), new_path(spark, "warc"), archive_bytes), "archives")
    return read_archives(archives.repartition(min(max(1, archives.count()), READERS)))  # a number that is given is kept
