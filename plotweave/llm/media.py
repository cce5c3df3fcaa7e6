"""Media columns with content-defined chunking.

A payload becomes an 8-bit grey image (binary PGM, 64 samples a row). Its bytes are cut
where a rolling gear hash of the last 32 bytes has ``CUT_BITS`` zero bits (Xia et al.
2016), so that equal passages give equal chunks wherever they stand. Chunks go by their
SHA-256.

1. Digests: a pass over the payloads gives each chunk's digest; an aggregation finds those
   that occur more than once, and which document owns each.
2. Store: a second pass writes one row a document: the ordered list of its chunks, and the
   bytes of those it owns. Each distinct chunk is stored once. A document learns which of its
   chunks are others' from the table of shared digests, broadcast if it has at most
   ``MAX_SHARED`` rows, else from a join by identifier.
3. Read: documents that own all their chunks are put together where they are read. The others
   fetch what they lack by a join on the digest, of shared chunks only. Every
   medium's digest is verified.

Cases: a null or empty payload is one row of zeros; repeated rows store their chunks once or,
having one identifier, each, and read alike; an empty table gives an empty table;
null identifiers own nothing that another document has; very long payloads are cut and stored whole; of equal
chunks it doesn't matter whose is stored. Only the columns named are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import byte_values, materialize, slices, with_text

WIDTH = 64
MIN_CHUNK, MAX_CHUNK, CUT_BITS = 512, 16_384, 11
#: Shared digests up to which they are broadcast.
MAX_SHARED = 1 << 19
#: Bytes hashed at once.
AT_ONCE = 1 << 22
#: The window of the gear hash in bytes: one bit leaves with each step.
REACH = 32
NOBODY = np.iinfo(np.int64).min
CUT_MASK = np.uint32(((1 << CUT_BITS) - 1) << (REACH - CUT_BITS))


def gear_table() -> np.ndarray:
    """A fixed pseudo-random 32-bit number for each byte: the head of SHA-256 of it."""
    return np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "little") for b in range(256)], np.uint32)


GEAR = gear_table()


def pad(data: bytes) -> bytes:
    """Zeros up to a positive multiple of the row's width."""
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def to_image(payload: bytes) -> bytes:
    return f"P5\n{WIDTH} {len(payload) // WIDTH}\n255\n".encode() + payload


def from_image(media: bytes) -> bytes:
    magic, size, depth, samples = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or depth != b"255" or width != WIDTH or len(samples) != width * height:
        raise ValueError("not an 8-bit grey image")
    return samples


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: the sum of ``GEAR[byte k back] << k``, by doubling."""
    h, step = GEAR[data], 1
    while step < REACH:
        longer = h.copy()
        longer[step:] += h[:-step] << np.uint32(step)
        h, step = longer, step * 2
    return h


def cuts(media: bytes) -> list[int]:
    """Ends of the chunks."""
    n, found, start = len(media), [], 0
    if n > MIN_CHUNK:
        data = np.frombuffer(media, np.uint8)
        marks = []
        for a in range(0, n, AT_ONCE):
            lead = min(a, REACH)
            h = gear_hashes(data[a - lead : a + AT_ONCE])[lead:]
            marks.append(np.flatnonzero((h & CUT_MASK) == 0) + a + 1)
        for mark in np.concatenate(marks).tolist():
            while mark - start > MAX_CHUNK:
                start += MAX_CHUNK
                found.append(start)
            if mark - start >= MIN_CHUNK:
                start = mark
                found.append(start)
    while n - start > MAX_CHUNK:
        start += MAX_CHUNK
        found.append(start)
    if start < n:
        found.append(n)
    return found


def chunks(media: bytes) -> list[tuple[bytes, bytes]]:
    """Digest and bytes of each chunk, in order."""
    ends = cuts(media)
    parts = [media[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    return [(hashlib.sha256(p).digest(), p) for p in parts]


def chunk_digests(texts: DataFrame) -> DataFrame:
    """``digest``, ``doc_id``: each distinct chunk of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, ids = [], []
            for doc_id, data in zip(batch.column(0).to_pylist(), byte_values(batch.column(1)), strict=True):
                own = {d for d, _ in chunks(to_image(pad(data)))}
                digests += own
                ids += [doc_id] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(ids, pa.int64())], ["digest", "doc_id"])

    return texts.mapInArrow(run, "digest binary, doc_id bigint")


def shared_digests(found: DataFrame) -> DataFrame:
    """``digest`` and ``owner`` (smallest identifier) of chunks of several rows."""
    counts = found.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("owner"))
    return counts.filter("n > 1").select("digest", F.coalesce("owner", F.lit(NOBODY)).alias("owner"))


STORE = "doc_id bigint, n_bytes bigint, media_sha256 string, digests array<binary>, foreign array<binary>, own array<binary>, lent array<struct<digest:binary,data:binary>>"
_PAIRS = pa.list_(pa.struct([("digest", pa.binary()), ("data", pa.binary())]))


def stored(doc_id: int | None, data: bytes, foreign: set[bytes], lent: set[bytes]) -> tuple:
    """A store row: the ordered digests, those of others, and the chunks owned, apart as private and lent."""
    media = to_image(pad(data))
    parts = chunks(media)
    first = dict(parts)
    lacking = [d for d in first if d in foreign]
    own = [p for d, p in first.items() if d not in foreign and d not in lent]
    out = [{"digest": d, "data": p} for d, p in first.items() if d in lent]
    return doc_id, len(data), hashlib.sha256(media).hexdigest(), [d for d, _ in parts], lacking, own, out


def _store_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.binary()), _PAIRS]
    names = ["doc_id", "n_bytes", "media_sha256", "digests", "foreign", "own", "lent"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


def store(docs: DataFrame, max_shared: int = MAX_SHARED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The chunk store: a row for each document, written to the shared folder."""
    texts = with_text(docs.withColumn(id_col, F.col(id_col).cast("bigint")), id_col, text_col)
    found = materialize(chunk_digests(texts), "chunk-digests")
    shared = materialize(shared_digests(found), "shared-chunks")
    if shared.count() <= max_shared:
        # At most max_shared rows of 40 bytes, as just counted.
        owners = docs.sparkSession.sparkContext.broadcast({bytes(r.digest): r.owner for r in shared.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                rows = []
                for doc_id, data in zip(batch.column(0).to_pylist(), byte_values(batch.column(1)), strict=True):
                    me = NOBODY if doc_id is None else doc_id
                    own = _Owned(owners.value, me)
                    rows.append(stored(doc_id, data, own.foreign, own.lent))
                yield _store_batch(rows)

        written = texts.mapInArrow(run, STORE)
    else:
        told = found.join(shared, "digest").groupBy("doc_id").agg(F.collect_set(F.when(F.col("owner") != F.coalesce("doc_id", F.lit(NOBODY)), F.col("digest"))).alias("foreign"), F.collect_set(F.when(F.col("owner") == F.coalesce("doc_id", F.lit(NOBODY)), F.col("digest"))).alias("lent"))
        told = told.withColumnRenamed("doc_id", "_id")
        joined = texts.join(told, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", "text", "foreign", "lent")

        def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                sets = ([set(x or ()) for x in batch.column(k).to_pylist()] for k in (2, 3))
                yield _store_batch([stored(i, data, f, n) for i, data, f, n in zip(batch.column(0).to_pylist(), byte_values(batch.column(1)), *sets, strict=True)])

        written = joined.mapInArrow(run_joined, STORE)
    return materialize(written.withColumn("row", F.monotonically_increasing_id()), "media-store")


class _Members:
    """The digests whose owner is, or isn't, a given document, as a container."""

    def __init__(self, owners: dict[bytes, int], me: int, mine: bool):
        self.owners, self.me, self.mine = owners, me, mine

    def __contains__(self, digest: bytes) -> bool:
        return digest in self.owners and (self.owners[digest] == self.me) == self.mine


class _Owned:
    def __init__(self, owners: dict[bytes, int], me: int):
        self.foreign, self.lent = _Members(owners, me, False), _Members(owners, me, True)


def rebuilt(digests: list[bytes], foreign: list[bytes], own: list[bytes], lent: list[dict], got: list[dict] | None, sha256: str) -> bytes:
    """The medium of a store row, verified."""
    have = {x["digest"]: x["data"] for x in (*lent, *(got or ()))}
    rest = iter(own)
    lacking = set(foreign)
    for d in digests:
        if d not in have:
            if d in lacking:
                raise ValueError(f"chunk {d.hex()} isn't in the store")
            have[d] = next(rest)
    media = b"".join(have[d] for d in digests)
    if hashlib.sha256(media).hexdigest() != sha256:
        raise ValueError(f"medium {sha256} was not rebuilt")
    return media


def read(stored_rows: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``media`` of every row of a store."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns = [batch.column(c).to_pylist() for c in ("digests", "foreign", "own", "lent", "got", "media_sha256")]
            media = [rebuilt(*row) for row in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = "array<struct<digest:binary,data:binary>>"
    lacking = stored_rows.filter(F.size("foreign") > 0)
    lent = stored_rows.filter(F.size("lent") > 0).select(F.explode("lent").alias("x")).select("x.digest", "x.data").dropDuplicates(["digest"])
    # Written first: with no aggregation behind the exchange, Spark can split the join where many lack one chunk.
    lent = materialize(lent, "lent-chunks")
    refs = lacking.select("row", F.explode("foreign").alias("digest"))
    got = refs.join(lent, "digest").groupBy("row").agg(F.collect_list(F.struct("digest", "data")).alias("got"))
    whole = stored_rows.filter(F.size("foreign") == 0).withColumn("got", F.lit(None).cast(kind))
    both = whole.unionByName(lacking.join(got, "row", "left").withColumn("got", F.col("got").cast(kind)))
    return both.drop("row").mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


def features(media: bytes) -> tuple[int, str, int, str]:
    """Payload length, its SHA-256, CRC-32 of the last row, and what describes the image."""
    samples = from_image(media)
    values = np.frombuffer(samples, np.uint8)
    counts = np.bincount(values, minlength=256)
    p = counts[counts > 0] / len(values)
    mean = float(values.mean())
    said = f"{WIDTH}x{len(values) // WIDTH};mean={mean:.3f};entropy={abs(float((p * np.log2(p)).sum())):.3f};zeros={int(counts[0])};chunks={len(cuts(media))}"
    return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-WIDTH:]), said


def described(media: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes``, the payload's and the medium's length and digest, and the features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            blobs = batch.column(2).to_pylist()
            found = [(*features(m), len(m), hashlib.sha256(m).hexdigest()) for m in blobs]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([f[k] for f in found], t) for k, t in enumerate(kinds))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "feature", "media_bytes", "media_sha256"])

    return media.mapInArrow(run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, feature string, media_bytes bigint, media_sha256 string")
