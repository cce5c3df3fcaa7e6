"""WARC archives: one gzip member per record, written by Spark, read sequentially.

A record is a ``response`` with an HTTP head and the payload, or a ``revisit`` that
refers to an earlier response with the same payload digest. Payloads of at least
``MIN_REVISIT`` bytes that occur more than once are stored once, with the largest
identifier.

Writing: only digests are aggregated and joined. A task puts members together until they have
``FILE_BYTES``, and Spark's text sink writes each such lot as a file (a row a file), so files are bounded by bytes,
not by records, and appear in any store that Spark can write, with its commit protocol. The
sink ends each row with a separator, here a zero byte: it is the last byte of a member,
the top byte of the length field, which is zero for records under 16 MiB; a larger record is
followed by an empty member. So the files are plain concatenated gzip.

Reading: a file's bytes (``FILE_BYTES`` and a record at most) go through one incremental inflater after another, one
for each member, in pieces of ``PIECE``; a record is framed by its ``Content-Length``, and block and payload digests are
verified. Records leave the reader in batches of bounded bytes. A wrong length, digest or a cut file raises.

Cases: a null or empty payload is an empty response; a null address becomes
``urn:none``; rows that repeat an identifier are records each, and none of them a revisit of
itself; among equal payloads the largest identifier wins; a null identifier is below
all, and stays null; a very long payload is a record, alone in its file if it is long enough; an empty table writes
no record. Only the columns named are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.llm.common import byte_values, fresh_path, materialize

MIN_REVISIT = 1000
LEVEL, PIECE = 6, 1 << 16
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:page:"
GZIP = 31
#: Bytes after which a file is closed, and payload bytes and rows of a batch that a reader gives.
FILE_BYTES, BATCH_BYTES, BATCH_ROWS = 32 << 20, 8 << 20, 1000
EMPTY_MEMBER = zlib.compressobj(1, zlib.DEFLATED, GZIP)
EMPTY_MEMBER = EMPTY_MEMBER.compress(b"") + EMPTY_MEMBER.flush()


class WarcError(ValueError):
    """A record that doesn't follow its own lengths or digests."""


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def kind(self) -> str:
        return self.headers.get("warc-type", "")

    @property
    def payload(self) -> bytes:
        """What follows the HTTP head."""
        return self.block.partition(b"\r\n\r\n")[2]


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def page_uri(page_id: int | None) -> str:
    return f"<{ID_PREFIX}{'none' if page_id is None else page_id}>"


def page_of(uri: str | None) -> int | None:
    name = (uri or "").strip("<>").removeprefix(ID_PREFIX)
    return int(name) if re.fullmatch(r"-?\d+", name) else None


def address(url: str | None) -> str:
    """An address that can stand on a header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:none"


def member(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, level: int = LEVEL) -> bytes:
    """A record as one gzip member, its last byte zero."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {page_uri(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {address(url)}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {page_uri(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: {sha1_label(payload)}", f"WARC-Block-Digest: {sha1_label(block)}", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(level, zlib.DEFLATED, GZIP)
    out = z.compress("\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n") + z.flush()
    return out if out[-1] == 0 else out + EMPTY_MEMBER


def members(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The inflated content of each gzip member of a byte stream."""
    z, parts, rest = None, [], b""
    for piece in pieces:
        rest = piece
        while rest:
            z = z or zlib.decompressobj(GZIP)
            parts.append(z.decompress(rest))
            rest = z.unused_data
            if z.eof:
                yield b"".join(parts)
                z, parts = None, []
    if z is not None:
        raise WarcError("the archive ends inside a member")


def parse(data: bytes) -> Record:
    """A record from a member's content."""
    head, found, body = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not found or not version.startswith("WARC/"):
        raise WarcError("no WARC header")
    headers = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
    try:
        length = int(headers["content-length"])
    except (KeyError, ValueError):
        raise WarcError("no content length") from None
    if body[length:] != b"\r\n\r\n":
        raise WarcError(f"{headers.get('warc-record-id')}: the block isn't {length} bytes long")
    return Record(headers, body[:length])


def verify(record: Record) -> Record:
    checks = [("warc-block-digest", record.block)]
    if record.kind == "response":
        checks.append(("warc-payload-digest", record.payload))
    for name, data in checks:
        if name in record.headers and record.headers[name] != sha1_label(data):
            raise WarcError(f"{record.headers.get('warc-record-id')}: wrong {name}")
    return record


def read_archive(content: bytes, piece: int = PIECE) -> Iterator[Record]:
    """The verified records of an archive, in order; empty members are passed over."""
    view = memoryview(content)
    for data in members(bytes(view[a : a + piece]) for a in range(0, len(view), piece)):
        if data:
            yield verify(parse(data))


def revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """``page_id``, ``digest``, ``refers_to`` of the records that repeat a payload."""
    keys = pages.select("page_id", F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").alias("n")).filter(F.col("n") >= min_bytes)
    last = keys.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1 and refers_to is not null")
    return keys.select("page_id", "digest").join(last.select("digest", "refers_to"), "digest").filter("page_id is null or page_id < refers_to").distinct()


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write every row as a record under ``path``."""
    own = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("html"))
    twice = revisits(own, min_bytes).withColumnRenamed("page_id", "_page").withColumnRenamed("digest", "_digest")
    rows = own.join(twice, F.col("page_id").eqNullSafe(F.col("_page")) & (F.sha1(F.col("html").cast("binary")) == F.col("_digest")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A file's members; the last byte is left to the sink.
        lot = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["value"])
        held, size = [], 0
        for batch in batches:
            ids, urls, refers = (batch.column(k).to_pylist() for k in (0, 1, 3))
            for i, u, p, r in zip(ids, urls, byte_values(batch.column(2)), refers, strict=True):
                held.append(member(i, u, p, r))
                size += len(held[-1])
                if size >= FILE_BYTES:
                    yield lot()
                    held, size = [], 0
        if held:
            yield lot()

    packed = rows.select("page_id", "url", "html", "refers_to").mapInArrow(run, "value binary")
    packed.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``page_id``, ``record_type``, ``url``, ``refers_to``, ``payload_digest`` (bare hex) and ``payload`` (null for revisits) of every record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                size = 0
                for r in read_archive(content.as_py()):
                    digest = base64.b32decode(r.headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                    rows.append((page_of(r.headers.get("warc-record-id")), r.kind, r.headers.get("warc-target-uri"), page_of(r.headers.get("warc-refers-to")), digest, r.payload if r.kind == "response" else None))
                    size += len(r.block)
                    if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield _batch(rows)
                        rows, size = [], 0
                yield _batch(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "page_id bigint, record_type string, url string, refers_to bigint, payload_digest string, payload binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)], [name for name, _ in kinds])


def resolved(records: DataFrame) -> DataFrame:
    """Records with ``payload_bytes``; a revisit takes it from the response it refers to, whose digest must be its own."""
    sizes = materialize(records.select("page_id", "record_type", "refers_to", "payload_digest", F.octet_length("payload").cast("bigint").alias("payload_bytes")), "warc-records")
    wanted = sizes.filter("record_type = 'revisit'").drop("payload_bytes")
    named = wanted.select("refers_to", "payload_digest").distinct()
    targets = sizes.filter("record_type = 'response'").join(named.withColumnRenamed("refers_to", "page_id"), ["page_id", "payload_digest"], "left_semi")
    targets = targets.select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    found = wanted.join(targets, ["refers_to", "payload_digest"], "left")
    checked = found.withColumn("payload_bytes", F.coalesce("payload_bytes", F.raise_error(F.concat(F.lit("no response for revisit "), F.col("page_id").cast("string"))).cast("bigint")))
    return sizes.filter("record_type = 'response'").unionByName(checked.select(*sizes.columns))


def round_trip(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back; returns ``read_archives``' rows."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(pages, path, min_bytes)
    return read_archives(spark, path)
