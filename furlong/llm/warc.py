"""WARC archives: writing pages as records and reading archives sequentially.

Each record is a gzip member of its own. The reader decompresses step by step, takes header lines up to the blank line,
frames the block by its Content-Length and checks the block and payload digests; it holds one record at a time.

Archives are written by Spark itself into any file system it knows: a task packs its records into archives of bounded
size and each becomes one file. Spark's text writer ends a file with a separator; a zero byte is used, which gzip
readers skip as padding. Reading uses Spark's binary file source, one bounded archive per row.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARCHIVE_BYTES = 8 << 20
SMALLEST_REVISIT = 100
#: Fixed by the WARC 1.1 standard.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
URN = "urn:page:"
FIELDS = ("record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, "
          "payload_digest string, payload binary")


class BrokenRecord(ValueError):
    """A record that does not keep to the format or whose digest differs."""


def record(identifier: str | None, uri: str | None, payload: bytes, digest: str, refers_to: str | None = None,
           date: str = DATE) -> bytes:
    """One record as a gzip member. With ``refers_to`` it is a revisit, which keeps the HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{urn(identifier)}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(uri or '', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        fields += [f"WARC-Refers-To: <{urn(refers_to)}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    raw = "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def urn(identifier: str | None) -> str:
    return "urn:nopage" if identifier is None else URN + quote(identifier, safe="")


def page_of(field: str | None) -> str | None:
    name = (field or "").strip("<>")
    return unquote(name.removeprefix(URN)) if name.startswith(URN) else None


def head_of(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])} | {"": lines[0]}


class Member:
    """Bytes of one gzip member, decompressed as they are asked for."""

    def __init__(self, source: Source):
        self.source, self.inflate, self.ready = source, zlib.decompressobj(31), bytearray()

    def more(self) -> bool:
        while not self.inflate.eof:
            raw = self.source.take()
            if not raw:
                raise BrokenRecord("the archive ends inside a record")
            try:
                out = self.inflate.decompress(raw, 1 << 16)
            except zlib.error as error:
                raise BrokenRecord(str(error)) from error
            self.source.back(self.inflate.unused_data or self.inflate.unconsumed_tail)
            if out:
                self.ready += out
                return True
        return False

    def until(self, mark: bytes, most: int = 1 << 20) -> bytes:
        looked = 0
        while (at := self.ready.find(mark, looked)) < 0:
            looked = max(0, len(self.ready) - len(mark) + 1)
            if len(self.ready) > most or not self.more():
                raise BrokenRecord("a header has no end")
        out = bytes(self.ready[:at])
        del self.ready[:at + len(mark)]
        return out

    def exactly(self, n: int) -> bytes:
        while len(self.ready) < n and self.more():
            pass
        if len(self.ready) < n:
            raise BrokenRecord("a block is shorter than its Content-Length")
        out = bytes(self.ready[:n])
        del self.ready[:n]
        return out

    def rest(self) -> bytes:
        while self.more():
            pass
        return bytes(self.ready)


class Source:
    """Raw bytes of an archive, with what a member left over given back."""

    def __init__(self, stream: BinaryIO, step: int = 1 << 16):
        self.stream, self.step, self.held = stream, step, b""

    def take(self) -> bytes:
        raw, self.held = self.held or self.stream.read(self.step), b""
        return raw

    def back(self, raw: bytes) -> None:
        self.held = raw

    def at_end(self) -> bool:
        """Skips zero padding."""
        while raw := self.take():
            self.held = raw.lstrip(b"\0")
            if self.held:
                return False
        return True


def records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case; the version under "") and block of each record, in order."""
    source = Source(stream)
    while not source.at_end():
        member = Member(source)
        fields = head_of(member.until(b"\r\n\r\n"))
        if not fields[""].startswith("WARC/"):
            raise BrokenRecord("no WARC version")
        try:
            length = int(fields.get("content-length", ""))
        except ValueError as error:
            raise BrokenRecord("no Content-Length") from error
        block = member.exactly(length)
        if member.rest() != b"\r\n\r\n":
            raise BrokenRecord("the member goes on after its record")
        check(fields.get("warc-block-digest"), block)
        yield fields, block


def check(stated: str | None, content: bytes) -> None:
    if stated is not None:
        name, _, value = stated.partition(":")
        if hashlib.new(name, content).hexdigest() != value:
            raise BrokenRecord(f"digest differs: {stated}")


def parsed(fields: dict[str, str], block: bytes, payloads: bool) -> tuple:
    """A row of ``FIELDS``. The payload of a response is checked against its digest; a revisit states both length and digest."""
    head, found, payload = block.partition(b"\r\n\r\n")
    revisit = fields.get("warc-type") == "revisit"
    digest = fields.get("warc-payload-digest", "")
    if not revisit:
        check(digest or None, payload if found else block)
    size = int(head_of(head).get("content-length", "0")) if revisit else len(payload)
    return (page_of(fields.get("warc-record-id")), fields.get("warc-type"), fields.get("warc-target-uri"),
            page_of(fields.get("warc-refers-to")), size, digest.rpartition(":")[2],
            payload if payloads and not revisit else None)


def decide(pages: DataFrame, identifier: str = "page_id", text: str = "html", uri: str = "url") -> DataFrame:
    """Which page is stored in full and which only refers to it: id, uri, payload, digest, refers_to.

    Of pages with equal payloads of at least 100 bytes the smallest id is the response, the others revisit it. A row
    that repeats both id and payload of the response is a response too. Null ids come last; null text is an empty
    payload.
    """
    rows = pages.select(
        F.col(identifier).alias("id"), F.col(uri).cast("string").alias("uri"),
        F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    first = rows.filter(F.length("payload") >= SMALLEST_REVISIT).groupBy(F.col("digest").alias("_digest")) \
        .agg(F.min("id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    # a merge join at any size: the side of repeated payloads grows with the table, and its hot digests are split
    return rows.join(first.hint("merge"), rows["digest"] == first["_digest"], "left").select(
        "id", "uri", "payload", "digest", F.expr("CASE WHEN id <=> _first THEN NULL ELSE _first END").alias("refers_to"))


def write_archives(decided: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write the result of ``decide`` as archives of about ``archive_bytes`` each, one file per archive."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bytearray()
        for batch in batches:
            for columns in zip(*(batch.column(i) for i in range(5))):
                identifier, uri, payload, digest, refers_to = (c.as_py() for c in columns)
                held += record(identifier, uri, payload, digest, refers_to)
                if len(held) >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([bytes(held)])], ["archive"])
                    held = bytearray()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([bytes(held)])], ["archive"])

    named = decided.select(F.col("id").cast("string"), "uri", "payload", "digest", F.col("refers_to").cast("string"))
    named.mapInArrow(pack, "archive binary").select(F.col("archive").cast("string").alias("value")) \
        .write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records of the archives under ``path`` as rows of ``FIELDS``. A broken record fails the job. No archives give no rows."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary()]
        names = [f.split()[0] for f in FIELDS.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for fields, block in records(io.BytesIO(content.as_py())):
                    rows.append(parsed(fields, block, payloads))
                    size += len(block) if payloads else 200
                    if size > 1 << 22:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(unpack, FIELDS)


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT payload_digest AS digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d LEFT JOIN f ON payload_digest = digest
"""
