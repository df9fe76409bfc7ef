"""WARC as a chunked record table.

Files of gzip members, one record each, are written from pages and read back as rows (record, chunk number, payload piece,
running digest). Reader and writer hold one piece of a payload at a time, so a record's size never meets a task's memory.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, scratch
from ..sources.files import open_input, open_output
from . import text as X

_READ = 1 << 16
#: Bytes of rows gathered before they leave a task's Python worker.
_BATCH = 4 << 20


class _Members(io.RawIOBase):
    """Bytes of concatenated gzip members, or of a plain file, inflated as they are asked for."""

    def __init__(self, raw: BinaryIO):
        self.raw, self.left, self.z = raw, raw.read(_READ), None
        self.plain = self.left[:2] != b"\x1f\x8b"

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        while True:
            if not self.left:
                self.left = self.raw.read(_READ)
                if not self.left:
                    if self.z is not None and not self.z.eof:
                        raise ValueError("the file ends inside a gzip member")
                    return 0
            if self.plain:
                out, self.left = self.left[: len(b)], self.left[len(b) :]
            else:
                if self.z is None or self.z.eof:
                    self.z = zlib.decompressobj(31)
                out = self.z.decompress(self.left, len(b))
                self.left = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if out:
                b[: len(out)] = out
                return len(out)


#: Bytes that a header may have. A longer WARC header is an error, a longer HTTP header is payload.
_HEAD = 1 << 20


def _head(f: BinaryIO, limit: int) -> tuple[str, dict[str, str], bytes, bool]:
    """First line, fields (names in lower case) and bytes of a header block of at most limit bytes, and whether its closing
    blank line is among them."""
    lines, left, closed = [], limit, False
    while left > 0 and not closed:
        line = f.readline(left)
        lines.append(line)
        left -= len(line)
        if not line.endswith(b"\n"):
            break
        closed = line in (b"\r\n", b"\n")
    text = [x.decode("utf-8", "replace") for x in lines]
    fields = {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in text[1:]) if name.strip()}
    return text[0].strip() if text else "", fields, b"".join(lines), closed


def records(raw: BinaryIO, chunk_bytes: int) -> Iterator[tuple]:
    """(record_id, type, uri, http_status, chunk_no, offset, payload, sha1, last) of every chunk of every record.

    sha1 is of the payload up to and with this chunk. A record without payload is one empty chunk. For HTTP messages the
    payload is the body, and empty for an empty block; a block without a whole HTTP header of at most 1 MiB is all payload,
    without a status. A file that ends inside a record, or starts one with anything else, a header of more than 1 MiB, or a
    length that is missing or no number, raises ValueError.
    """
    f = io.BufferedReader(_Members(raw), _READ)
    while True:
        while (lead := f.peek(1)[:1]) in (b"\r", b"\n"):
            f.read(1)
        if not lead:
            return
        version, head, _, closed = _head(f, _HEAD)
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record where one should start: {version[:40]!r}")
        if not closed or not head.get("content-length", "").isdigit():
            raise ValueError("a WARC header that does not end, or without a length")
        left, status, ahead = int(head["content-length"]), None, b""
        if left and head.get("content-type", "").startswith("application/http"):
            line, _, ahead, whole = _head(f, min(left, _HEAD))
            if whole:
                left, ahead = left - len(ahead), b""
                parts = line.split()
                status = int(parts[1]) if len(parts) > 1 and parts[1].isdigit() else None
        digest, number, offset = hashlib.sha1(), 0, 0
        while True:
            size = min(chunk_bytes, left)
            piece, ahead = ahead[:size], ahead[size:]
            piece += f.read(size - len(piece)) if len(piece) < size else b""
            if len(piece) < size:
                raise ValueError("the file ends inside a record")
            left -= size
            digest.update(piece)
            yield head.get("warc-record-id"), head.get("warc-type"), head.get("warc-target-uri"), status, number, offset, piece, digest.hexdigest(), left == 0
            number, offset = number + 1, offset + len(piece)
            if not left:
                break


def record_id(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def write(pages: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Writes a .warc.gz of response records from each partition of pages (page_id, url, html) into folder; returns
    (path, records) of the files that tasks completed: a lost attempt's file is in no row, and readers go by these rows.

    A null page_id or url gives an empty one in the header, a null html an empty payload. Line ends in a url are dropped.
    Other columns are ignored; repeated rows are records of their own. The html goes into the deflater in pieces.
    """

    def run(batches):
        out, path, n = None, None, 0
        for b in batches:
            for page_id, url, html in zip(b.column(0), b.column(1), b.column(2)):
                if out is None:
                    path = f"{folder}/part-{uuid.uuid4().hex}.warc.gz"
                    out = open_output(path)
                buf = memoryview(html.as_buffer()) if html.is_valid else memoryview(b"")
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
                target = (url.as_py() or "").replace("\r", "").replace("\n", "")
                head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: {record_id(page_id.as_py())}\r\nWARC-Target-URI: {target}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(http) + len(buf)}\r\n\r\n"
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                out.write(z.compress(head.encode() + http))
                for k in range(0, len(buf), _READ):
                    out.write(z.compress(buf[k : k + _READ]))
                out.write(z.compress(b"\r\n\r\n") + z.flush())
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([n], pa.int64())})

    rows = pages.select(F.col("page_id").cast("string"), F.col("url").cast("string"), F.col("html").cast("string"))
    return cut(rows.mapInArrow(X.lean(run), "path string, records long"), "warc-files")


SCHEMA = pa.schema([("record_id", pa.string()), ("warc_type", pa.string()), ("uri", pa.string()), ("http_status", pa.int32()), ("chunk_no", pa.int32()), ("offset", pa.int64()), ("payload", pa.binary()), ("sha1", pa.string()), ("last", pa.bool_())])
_DDL = "record_id string, warc_type string, uri string, http_status int, chunk_no int, offset long, payload binary, sha1 string, last boolean"


def read(paths: DataFrame, chunk_bytes: int = 1 << 14) -> DataFrame:
    """The chunked record table of the files in the column path of paths, one file after another in each task.

    No path gives no rows, and neither does a null path or an empty file. A file that is cut short fails the task.
    """

    def run(batches):
        rows, size = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SCHEMA)], schema=SCHEMA)

        for b in batches:
            for path in b.column(0).to_pylist():
                if path is None:
                    continue
                with open_input(path) as raw:
                    for r in records(raw, chunk_bytes):
                        rows.append(r)
                        size += len(r[6]) + 200
                        if size > _BATCH:
                            yield batch()
                            rows, size = [], 0
        if rows:
            yield batch()

    n = max(1, min(paths.count(), 100_000))
    return paths.select("path").repartition(n).mapInArrow(X.lean(run), _DDL)


def roundtrip(pages: DataFrame, chunk_bytes: int = 1 << 14) -> DataFrame:
    """pages as WARC files in the shared folder, read again as chunks: (record_id, uri, chunk_no, offset, n_bytes, payload,
    sha1, last). payload is base64; sha1 covers the record's payload up to and with the chunk.

    A null or empty html gives one empty chunk, a null page_id the id <urn:page:>, a null url an empty uri; repeated rows
    are repeated records; other columns are ignored; an empty table gives no rows.
    """
    folder = scratch(pages.sparkSession, "warc")
    chunks = read(write(pages, folder), chunk_bytes)
    return chunks.select("record_id", "uri", "chunk_no", "offset", F.octet_length("payload").alias("n_bytes"), F.translate(F.base64("payload"), "\r\n", "").alias("payload"), "sha1", "last")
