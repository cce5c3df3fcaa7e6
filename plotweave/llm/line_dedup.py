"""Line deduplication by a sharded minimal perfect hash.

1. Count: every line's normalised key gives a 128-bit hash; an aggregation (partial
   first, so a line that a third of all documents hold costs a row per task) finds
   the number of documents and the largest identifier of each hash.
2. Index: the hashes found in enough documents are dealt into shards by hash, of
   about ``SHARD_KEYS`` keys each. A shard is a minimal perfect hash and, in its
   order, a 64-bit fingerprint array, a count array and an array of the largest
   identifiers: about 21 bytes a line, however long the lines are.
3. Probe: documents look their line hashes up in the arrays. Where all shards
   together are within ``max_broadcast`` bytes they are broadcast and the texts never
   shuffle. Beyond it, probes (hashes, not lines) go to the shards' tasks and stream past
   the arrays in Arrow batches; the hits join back to the documents. A shard has as many salts, hence tasks and copies of its arrays, as the
   documents that hold its lines ask for, at ``PROBES`` each: a line that a third of all documents hold spreads over many
   tasks, a shard of rare lines has one.

Cases: a null or empty text is one empty line; a null identifier is below every other; each row is a document, so rows that repeat an
identifier count each towards the number of documents and get the same verdicts, and the last identifier keeps the line in all its rows; an
identifier that is no number raises; ties can't occur, identifiers being compared whole; very long texts and lines are
read whole; an empty table gives an empty table. Only the columns named are read.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import SPACE, byte_values, materialize, no_clash, slices
from plotweave.llm.mph import PerfectHash

MIN_CHARS, MIN_DOCS = 40, 5
SHARD_KEYS = 1 << 18
#: Probes of a salt of a shard, about.
PROBES = 1 << 22
#: Bytes of all arrays together up to which they are broadcast.
MAX_BROADCAST = 64 << 20
_STRIP = SPACE.encode()

#: The shards that this process has loaded, under their build's name.
_LOADED: dict[str, dict] = {}


def line_key(line: bytes) -> bytes:
    return line.strip(_STRIP).lower()


def line_hashes(text: bytes, min_chars: int) -> tuple[list[bytes], list[bytes | None]]:
    """The lines, and the 128-bit hash of each key that is long enough."""
    lines = text.split(b"\n")
    hashes: list[bytes | None] = []
    for line in lines:
        key = line_key(line) if len(line) >= min_chars else b""
        long = len(key) >= min_chars and len(key.decode()) >= min_chars
        hashes.append(xxhash.xxh3_128_digest(key) if long else None)
    return lines, hashes


def halves(hashes: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(hashes), ">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _hash_rows(texts: DataFrame, min_chars: int) -> DataFrame:
    """A row for each document and distinct long line in it; with ``key``, a hash of the text, where ``texts`` has it."""
    names = ["doc_id", "h1", "h2", *texts.columns[2:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            row, found = [], []
            for k, text in enumerate(byte_values(batch.column(1))):
                own = {h for h in line_hashes(text, min_chars)[1] if h}
                row += [k] * len(own)
                found += own
            high, low = halves(found)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), *(c.take(at) for c in batch.columns[2:])], names)

    return texts.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def line_counts(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``h1``, ``h2``, ``n_docs``, ``last_doc`` of the lines found in at least ``min_docs`` documents."""
    rows = _hash_rows(_texts(docs, id_col, text_col), min_chars)
    counts = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))
    return counts.filter(F.col("n_docs") >= min_docs)


def _texts(docs: DataFrame, id_col: str, text_col: str, *carry: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *carry)


def build_index(counts: DataFrame, shards: int) -> DataFrame:
    """``shard``, ``arrays`` (pickled), ``nbytes``, ``probes`` (documents by line, all its lines together): one row per shard that has lines."""

    def build(rows: pa.Table) -> pa.Table:
        high, low = (rows.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        perfect = PerfectHash.build(high, low)
        at = perfect.index(high, low)
        fingerprint, n_docs, last = np.empty(len(at), np.uint64), np.empty(len(at), np.uint32), np.empty(len(at), np.int64)
        fingerprint[at], last[at] = low, rows.column("last_doc").fill_null(np.iinfo(np.int64).min).to_numpy()
        n_docs[at] = np.minimum(rows.column("n_docs").to_numpy(), 2**32 - 1)
        blob = pickle.dumps((perfect, fingerprint, n_docs, last), protocol=5)
        return pa.table({"shard": rows.column("shard").slice(0, 1), "arrays": pa.array([blob], pa.binary()), "nbytes": pa.array([len(blob)], pa.int64()), "probes": pa.array([int(rows.column("n_docs").to_numpy().sum())], pa.int64())})

    keyed = counts.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))
    return keyed.groupBy("shard").applyInArrow(build, "shard int, arrays binary, nbytes bigint, probes bigint")


def drops(arrays: tuple, high: np.ndarray, low: np.ndarray, doc_ids: np.ndarray, min_docs: int) -> np.ndarray:
    """Which probes are frequent lines outside the largest identifier that holds them."""
    perfect, fingerprint, n_docs, last = arrays
    at = perfect.index(high, low)
    known = at >= 0
    known[known] = fingerprint[at[known]] == low[known]
    out = np.zeros(len(at), bool)
    out[known] = (n_docs[at[known]] >= min_docs) & (last[at[known]] != doc_ids[known])
    return out


def _rewrite(batch: pa.RecordBatch, dropped_of) -> pa.RecordBatch:
    """Columns doc_id, text, n_lines, n_dropped and what else the batch carries; ``dropped_of`` gives a flag for each probe."""
    kept, n_lines, all_lines, all_hashes = [], [], [], []
    for text in byte_values(batch.column(1)):
        lines, hashes = line_hashes(text, dropped_of.min_chars)
        all_lines.append(lines)
        all_hashes.append(hashes)
    flags = iter(dropped_of(batch, all_hashes))
    for lines, hashes in zip(all_lines, all_hashes, strict=True):
        stay = [line for line, h in zip(lines, hashes, strict=True) if h is None or not next(flags)]
        n_lines.append((len(lines), len(lines) - len(stay)))
        kept.append(b"\n".join(stay))
    columns = [batch.column(0), pa.array(kept, pa.binary()).cast(pa.string()), *(pa.array([x[i] for x in n_lines], pa.int64()) for i in (0, 1)), *batch.columns[2 + dropped_of.extra :]]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "n_lines", "n_dropped", *batch.schema.names[2 + dropped_of.extra :]])


class _ProbeBroadcast:
    """Looks probes up in broadcast shards."""

    extra = 0

    def __init__(self, broadcast, shards: int, min_chars: int, min_docs: int):
        self.broadcast, self.shards, self.min_chars, self.min_docs = broadcast, shards, min_chars, min_docs
        self.name = uuid.uuid4().hex

    def __call__(self, batch: pa.RecordBatch, hashes: list) -> list[bool]:
        if self.name not in _LOADED:
            _LOADED.clear()
            _LOADED[self.name] = {k: pickle.loads(blob) for k, blob in self.broadcast.value.items()}
        shards = _LOADED[self.name]
        ids = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy()
        doc_ids = np.repeat(ids, [sum(h is not None for h in own) for own in hashes])
        high, low = halves([h for own in hashes for h in own if h])
        shard = high.view(np.int64) % self.shards
        out = np.zeros(len(high), bool)
        for k in np.unique(shard):
            if k in shards:
                mine = shard == k
                out[mine] = drops(shards[k], high[mine], low[mine], doc_ids[mine], self.min_docs)
        return out.tolist()


class _ProbeHits:
    """Takes each document's hits from the column after its text."""

    extra = 1

    def __init__(self, min_chars: int):
        self.min_chars = min_chars

    def __call__(self, batch: pa.RecordBatch, hashes: list) -> list[bool]:
        out: list[bool] = []
        for hits, own in zip(batch.column(2), hashes, strict=True):
            found = set(hits.as_py() or ())
            out += [h in found for h in own if h]
        return out


def _probe_shuffled(rows: DataFrame, index: DataFrame, shards: int, min_docs: int, probes: int) -> DataFrame:
    """``doc_id``, ``key`` and ``hits`` (binary hashes) of documents that lose lines.

    A partition's rows come sorted with each shard's arrays before its probes, so
    a task holds one shard and one batch of probes at a time.
    """
    shard = F.pmod("h1", F.lit(shards)).cast("int")
    salts = index.select("shard", F.ceil(F.col("probes") / probes).cast("int").alias("salts"))
    # A row a shard, of some 2^18 lines each. Probes of a shard without lines are left out here.
    salted = rows.withColumn("shard", shard).join(F.broadcast(salts), "shard")
    salted = salted.select("shard", F.pmod(F.xxhash64("doc_id", "key"), "salts").cast("int").alias("salt"), F.lit(1).alias("kind"), "doc_id", "key", "h1", "h2", F.lit(None).cast("binary").alias("arrays"))
    none = lambda c: F.lit(None).cast("bigint").alias(c)
    copies = index.join(salts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), none("doc_id"), none("key"), F.lit(0).cast("bigint").alias("h1"), F.lit(0).cast("bigint").alias("h2"), "arrays")
    tasks = copies.unionByName(salted).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, held = None, None
        for batch in batches:
            shard, kind = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            starts = [*np.flatnonzero(kind == 0), len(kind)]
            for start, end in zip([0, *starts[:-1]], starts, strict=True):
                if start == end:
                    continue
                if kind[start] == 0:
                    arrays, held = pickle.loads(batch.column(7)[int(start)].as_py()), shard[start]
                part = batch.slice(int(start), int(end - start))
                part = part.filter(pa.array((kind[start:end] == 1) & (shard[start:end] == (-1 if held is None else held))))
                high, low = (part.column(c).to_numpy().view(np.uint64) for c in (5, 6))
                ids = part.column(3).fill_null(np.iinfo(np.int64).min).to_numpy()
                lost = drops(arrays, high, low, ids, min_docs) if len(ids) else np.zeros(0, bool)
                hashes = np.stack([high[lost], low[lost]], 1).astype(">u8")
                yield pa.RecordBatch.from_arrays([*(part.column(c).filter(pa.array(lost)) for c in (3, 4)), pa.array([h.tobytes() for h in hashes], pa.binary())], ["doc_id", "key", "hit"])

    hits = tasks.mapInArrow(run, "doc_id bigint, key bigint, hit binary")
    # A document's own lines; rows of equal identifier and text share them.
    return hits.groupBy("doc_id", "key").agg(F.collect_set("hit").alias("hits"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, max_broadcast: int = MAX_BROADCAST, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), probes: int = PROBES) -> DataFrame:
    """``doc_id``, ``text`` (the lines that stay), ``n_lines``, ``n_dropped``, then the carried columns."""
    no_clash(carry, "doc_id", "text", "n_lines", "n_dropped", "hits")
    texts = _texts(docs, id_col, text_col, *carry)
    counts = materialize(line_counts(docs, min_chars, min_docs, id_col, text_col), "line-counts")
    shards = max(1, -(-counts.count() // SHARD_KEYS))
    index = materialize(build_index(counts, shards), "line-index", codec="none")
    total = index.agg(F.sum("nbytes")).first()[0] or 0
    fields = ["doc_id bigint", "text string", "n_lines bigint", "n_dropped bigint", *(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*carry).schema)]
    if total <= max_broadcast:
        # Bounded by the check just made.
        shared = docs.sparkSession.sparkContext.broadcast({r.shard: bytes(r.arrays) for r in index.collect()})
        probe = _ProbeBroadcast(shared, shards, min_chars, min_docs)
    else:
        key = F.xxhash64("text")
        hits = _probe_shuffled(_hash_rows(_texts(docs, id_col, text_col).withColumn("key", key), min_chars), index, shards, min_docs, probes)
        texts = texts.join(hits, texts["doc_id"].eqNullSafe(hits["doc_id"]) & (key == hits["key"]), "left").select(texts["doc_id"], "text", "hits", *carry)
        probe = _ProbeHits(min_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield _rewrite(batch, probe)

    return texts.mapInArrow(run, ", ".join(fields))
