"""Near-duplicates by SimHash, found with Golay-code fuzzy hashing.

1. A text's fingerprint has a bit for each bit position that is set in over half of its
   shingles' hashes. From here on only distinct fingerprints matter, so a group
   of copies is one row.
2. A fingerprint is three segments of 22, 21 and 21 bits. If two fingerprints differ in
   at most two bits, one segment is free of errors and another has at most one; of the pairs
   (first, second), (second, third), (third, first) one always has an exact first and a
   second with at most one error (pigeonhole). The keys of a fingerprint are, for each pair, the
   exact segment with every codeword index of the other: about 16 keys of 36 bits.
3. Fingerprints that share a key are compared. Buckets of at most ``BUCKET`` fingerprints are
   compared within themselves and give links to the smallest fingerprint of each connected part. Larger
   ones take another exact way of linear size: two fingerprints differ in at most two bits
   if and only if some word is within one bit of both, so each gives its 65 such words, and the
   fingerprints of a word link to the smallest of them.
4. Connected components of the links; a component's name is its smallest identifier.

Cases: a null or empty text, or one without words, has fingerprint 0, which links like
any other; fewer words than a shingle make one shingle; repeated rows and ties share a
component; null identifiers never name a component that has another; very long texts are read whole, the
bits of their shingles added up in parts; an empty table gives an empty table. Only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave.llm import golay
from plotweave.llm.common import byte_values, materialize, remove, with_text
from plotweave.llm.components import components

SEED, SHINGLE, DISTANCE = 42, 5, 2
#: Width and lowest bit of the segments.
SEGMENTS = ((22, 42), (21, 21), (21, 0))
PAIRS = ((0, 1), (1, 2), (2, 0))
BUCKET = 64
#: Shingles whose bits are counted at once.
AT_ONCE = 1 << 16


def bit_totals(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes (64 bits, unsigned) have each bit, counted in parts."""
    totals = np.zeros(64, np.int64)
    for start in range(0, len(hashes), AT_ONCE):
        part = np.ascontiguousarray(hashes[start : start + AT_ONCE], "<u8")
        totals += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return totals


def majority(totals: np.ndarray, runs: int) -> int:
    """The fingerprint of ``runs`` shingles whose bits add up to ``totals``."""
    return int(np.packbits(2 * totals > runs, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    runs = max(1, len(words) - shingle + 1)
    totals = np.zeros(64, np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for start in range(0, runs, AT_ONCE):
        part = words[start : min(runs, start + AT_ONCE) + shingle - 1]
        hashes = [digest(join(w), SEED) for w in zip(*(part[k:] for k in range(shingle)), strict=False)] if len(words) >= shingle else [digest(join(words), SEED)]
        totals += bit_totals(np.array(hashes, np.uint64))
    return majority(totals, runs)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in byte_values(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    texts = with_text(docs, id_col, text_col)
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, fp bigint")


def fuzzy_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the fingerprints (unsigned), and the row that each belongs to."""
    parts = [(words >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64) for width, low in SEGMENTS]
    keys, rows = [], []
    for pair, (exact, fuzzy) in enumerate(PAIRS):
        index = golay.indices(parts[fuzzy])
        key = (np.int64(pair) << 34 | parts[exact] << 12)[:, None] | index
        some = index >= 0
        keys.append(key[some])
        rows.append(np.nonzero(some)[0])
    return np.concatenate(keys), np.concatenate(rows)


def _keyed(distinct: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            keys, rows = fuzzy_keys(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows])], ["key", "fp"])

    return distinct.select("fp").mapInArrow(run, "key bigint, fp bigint")


def bucket_links(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links of a small bucket: each fingerprint to the smallest of its connected part."""
    words = np.sort(fps).view(np.uint64)
    near = np.bitwise_count(words[:, None] ^ words[None, :]) <= DISTANCE
    label = np.arange(len(words))
    while True:
        least = np.where(near, label[None, :], len(words)).min(1)
        if (least == label).all():
            break
        label = least
    signed = words.view(np.int64)
    return [(int(signed[i]), int(signed[j])) for i, j in enumerate(label) if i != j]


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``u``, ``v``: links between distinct fingerprints that connect all those within two bits."""
    keyed = materialize(_keyed(distinct), "fuzzy-keys")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = keyed.join(sizes, "key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for fps in batch.column(0) for x in bucket_links(fps.values.to_numpy())]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    small = shared.filter(F.col("n") <= bucket).groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(compare, "u bigint, v bigint")
    large = shared.filter(F.col("n") > bucket).select("fp").distinct()
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), k)))
    around = large.select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("word"))
    least = around.groupBy("word").agg(F.min("fp").alias("v"), F.max("fp").alias("most")).filter("v <> most").select("word", "v")
    far = around.join(least, "word").filter("fp <> v").select(F.col("fp").alias("u"), "v")
    return small.unionByName(far).distinct()


def classes(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``fp`` and ``root``, the smallest fingerprint reachable, of distinct fingerprints."""
    near = links(distinct, bucket)
    roots = components(near).select(F.col("node").alias("fp"), "root")
    remove(distinct.sparkSession, near)  # the keys: components has read them
    return distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` (signed long) and ``component_id`` of each row."""
    rows = materialize(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct-fingerprints")
    named = classes(distinct, bucket)
    names = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rows.join(named.join(names, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
