"""WARC: archives of one gzip member per record, and a sequential reader.

The reader inflates incrementally, frames each record by its Content-Length and verifies block and payload digests.
Archives are bytes in a column, written as a table where any Hadoop file system can hold them; `read_archives` takes
such a table, and `warc_files` makes one of .warc or .warc.gz files.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.common import sliced, staged

#: Uncompressed bytes after which an archive is closed.
ARCHIVE_BYTES = 4 << 20
_INFLATE = 64 << 10
_CRLF = b"\r\n"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _line(value: str) -> str:
    """A header value: control characters percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else "".join(f"%{x:02X}" for x in c.encode()) for c in value)


def write_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One gzip member: a response record, or a revisit that carries the response's headers but not its payload."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    head += [f"WARC-Target-URI: {_line(url)}"] if url is not None else []
    head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []
    head += [f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress(raw) + gz.flush()


class Feed:
    """Bytes of an archive in order, inflated a little at a time, members end to end; plain archives pass through."""

    def __init__(self, source: bytes | BinaryIO):
        self.file = io.BytesIO(source) if isinstance(source, bytes) else source
        self.left, self.out = self.file.read(_INFLATE), bytearray()
        self.gz = zlib.decompressobj(31) if self.left[:2] == b"\x1f\x8b" else None

    def more(self) -> bool:
        """Inflates a further piece; False at the end. Raises on a member that is cut off."""
        piece, self.left = self.left or self.file.read(_INFLATE), b""
        if not piece:
            if self.gz is not None and not self.gz.eof:
                raise ValueError("the archive ends inside a member")
            return False
        if self.gz is None:
            self.out += piece
            return True
        if self.gz.eof:
            self.gz = zlib.decompressobj(31)
        self.out += self.gz.decompress(piece)
        if self.gz.eof:
            self.left = self.gz.unused_data
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What comes before the mark, which is dropped; None if nothing is left."""
        seen = 0
        while (k := self.out.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.out)
            if not self.more():
                if self.out.strip():
                    raise ValueError("the archive ends inside a header")
                return None
        got = bytes(self.out[:k])
        del self.out[: k + len(mark)]
        return got

    def take(self, n: int) -> bytes:
        while len(self.out) < n:
            if not self.more():
                raise ValueError("the archive ends inside a block")
        got = bytes(self.out[:n])
        del self.out[:n]
        return got


_DIGESTS = {"sha1": 20, "md5": 16, "sha256": 32, "sha512": 64}


def digest_agrees(stated: str, data: bytes) -> bool:
    """Whether a labelled digest (sha1, md5, sha256 or sha512; base32 or hex) is data's. Unknown labels can't be verified."""
    label, _, value = stated.strip().partition(":")
    label = label.lower().replace("-", "")
    if label not in _DIGESTS:
        return True
    raw = hashlib.new(label, data).digest()
    return value.lower() == raw.hex() or value.upper().rstrip("=") == base64.b32encode(raw).decode().rstrip("=")


def _unchunked(body: bytes) -> bytes:
    """The body without HTTP's chunk lengths; the body itself if it isn't chunked throughout."""
    out, at = [], 0
    while True:
        line, _, _ = body[at : at + 64].partition(_CRLF)
        size = line.partition(b";")[0].strip()
        if not size or size.strip(b"0123456789abcdefABCDEF"):
            return body
        at += len(line) + 2
        n = int(size, 16)
        if n == 0:
            return b"".join(out)
        out.append(body[at : at + n])
        at += n + 2


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}


def read_records(source: bytes | BinaryIO) -> Iterator[dict]:
    """Records of an archive in order: headers, type, payload (None in a revisit) and payload size; digests verified.

    An open file is read a piece at a time, so an archive of any size needs the memory of its largest record.
    """
    feed = Feed(source)
    while (head := feed.until(_CRLF + _CRLF)) is not None:
        if not head.lstrip().startswith(b"WARC/"):
            raise ValueError("no WARC record where one should start")
        f = _fields(head.lstrip())
        if not f.get("content-length", "").isdigit():
            raise ValueError("a record has no length")
        block = feed.take(int(f["content-length"]))
        if feed.take(4) != _CRLF + _CRLF:
            raise ValueError("a record's block has another length than it says")
        if not digest_agrees(f.get("warc-block-digest", ""), block):
            raise ValueError("block digest differs")
        payload, size = block, len(block)
        if f.get("content-type", "").startswith("application/http"):
            http, _, payload = block.partition(_CRLF + _CRLF)
            said = _fields(http).get("content-length", "")
            size = int(said) if f.get("warc-type") == "revisit" and said.isdigit() else len(payload)
        stated = f.get("warc-payload-digest", "")
        if f.get("warc-type") == "revisit":
            payload = None
        elif not (digest_agrees(stated, payload) or digest_agrees(stated, _unchunked(payload))):  # writers differ on chunked bodies
            raise ValueError("payload digest differs")
        yield {"fields": f, "type": f.get("warc-type", ""), "payload": payload, "size": size, "digest": stated.partition(":")[2] or sha1_base32(payload or b"")}


def _id(urn: str | None) -> int | None:
    tail = (urn or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


def write_archives(pages: DataFrame, min_revisit_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(archive, records): a staged table of archives with a record for each row of pages.

    Of rows with equal payloads of at least min_revisit_bytes bytes, those with the smallest id are responses and the
    others revisits of it; equal is by SHA-1 and length. Null html is an empty payload; a null id is never revisited
    and, where another id has its payload, is a revisit; a null url is left out. Rows that repeat the smallest id are all
    responses. Extra columns are not read; an empty table gives no archive.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("key", F.concat_ws(":", F.sha1("payload"), F.octet_length("payload").cast("string")))
    groups = rows.where(F.octet_length("payload") >= min_revisit_bytes).groupBy("key").agg(F.min("page_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    # only groups with copies matter: their keys are few beside the pages, and Spark sizes them before it joins
    rows = rows.join(groups.select("key", "least"), "key", "left")
    rows = rows.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("least")), F.col("least")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, records, size = [], 0, 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary()), pa.array([records], pa.int64())], ["archive", "records"])
        for b in sliced(batches, 64):
            for page, url, payload, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                members.append(write_record(page, url, payload, refers))
                records, size = records + 1, size + len(payload)
                if size >= ARCHIVE_BYTES:
                    yield pack()
                    members, records, size = [], 0, 0
        if members:
            yield pack()

    return staged(rows.mapInArrow(run, "archive binary, records long"), "warc")


def read_archives(archives: DataFrame, archive_col: str = "archive", with_payload: bool = True) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest[, payload]): a row for each record read.

    Digests and lengths are of the full payload, also for revisits, whose payload column is null. A broken archive
    raises: the job fails rather than lose records.
    """
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"] + ["payload"] * with_payload
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                rows = []
                for r in read_records(x.as_py() or b""):
                    f = r["fields"]
                    rows.append((_id(f.get("warc-record-id")), f.get("warc-target-uri"), r["type"], _id(f.get("warc-refers-to")), r["size"], r["digest"], r["payload"])[: len(names)])
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names)

    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * with_payload
    return archives.select(archive_col).mapInArrow(run, schema)


def warc_files(spark: SparkSession, path: str) -> DataFrame:
    """(archive): the bytes of .warc and .warc.gz files on any file system that Spark reads, each below 2 GB (Spark's limit for a
    value); `read_records` streams larger ones from an open file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("content").alias("archive"))
