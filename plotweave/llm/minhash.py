"""Near-duplicates by SimHash and the similarity of their sets of word shingles.

Two texts are linked if the Jaccard similarity of their sets of distinct five-word shingles is at least
``SIMILARITY``. SimHash proposes, MinHash adds what SimHash can't see, the sets themselves decide:

1. A text's set of shingle hashes has a name (a hash of the set); texts of equal sets are one row from here on.
2. The same shingles, repeats included, give the text's fingerprint. ``simhash.classes`` joins fingerprints within two bits by
   their Golay keys; the sets of a class are candidates. Texts of one set may have several fingerprints, as repeats
   count there; the set is then in the class of each.
3. Two bits of 64 answer to a similarity of about 0.99, so beside it a set has ``BANDS`` keys, each of the minima of
   ``ROWS`` hash functions. Sets that share a key are candidates too; a pair of similarity s shares none with
   probability (1 - s^ROWS)^BANDS, 3e-6 at 0.8. With ``bands=0`` SimHash proposes alone.
4. Classes and keys are buckets alike. First each set is compared with the smallest of each of its buckets, which
   joins a group of copies in linear time. Buckets that then still hold several components are searched whole: those of at most
   ``BUCKET`` sets by pairs across components, which is linear in the rows; larger ones in blocks of about
   ``BLOCK`` sets, each two of which are multiplied as 0/1 matrices in a task of their own. No row per
   pair is made there, no task gets more than two blocks, and only links that join components come out. The
   work on a bucket still grows with the square of its sets; nothing is capped.
5. Connected components of the links; a component's name is its smallest identifier.

Only sets of candidates are made again and shuffled, as 64-bit hashes.

Cases: null and empty texts, and those without words, share the empty set and a component; fewer words than a
shingle make one shingle; repeated rows share a component; null identifiers never name a component
that has another; very long texts are read whole; an empty table gives an empty table. Only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.llm import simhash
from plotweave.llm.common import byte_values, materialize, release_shuffles, remove, slices, with_text
from plotweave.llm.components import components

SEED, SHINGLE = 42, 5
#: 0.8 as a fraction: counts are compared as integers.
SIMILARITY = 4, 5
BANDS, ROWS = 32, 5
#: Sets of a bucket that are compared pair by pair at most, and sets of a block beyond that.
BUCKET, BLOCK = 64, 256
#: Shingles whose hash functions are evaluated at once, and columns of the matrices that are multiplied.
AT_ONCE, COLUMNS = 1 << 12, 1 << 13
_draws = np.random.default_rng(SEED)
MASKS, FACTORS = (_draws.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) for _ in range(2))
FACTORS |= np.uint64(1)


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the shingles, repeats included, those of ``simhash.fingerprint``."""
    words = text.lower().split()
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < shingle:
        return np.array([digest(join(words), SEED)], np.uint64)
    return np.fromiter((digest(join(w), SEED) for w in zip(*(words[k:] for k in range(shingle)), strict=False)), np.uint64)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the shingles, in order."""
    return np.unique(shingle_hashes(text, shingle))


def described(text: bytes, shingle: int = SHINGLE) -> tuple[int, np.ndarray]:
    """The fingerprint of a text, and the set of its hashes."""
    hashes = shingle_hashes(text, shingle)
    return simhash.majority(simhash.bit_totals(hashes), len(hashes)), np.unique(hashes)


def set_name(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def band_keys(hashes: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """The first ``bands`` keys of a set (signed); none of the empty one."""
    if not len(hashes) or not bands:
        return np.zeros(0, np.int64)
    masks, factors = MASKS[: bands * ROWS], FACTORS[: bands * ROWS]
    least = np.full(bands * ROWS, np.iinfo(np.uint64).max)
    for start in range(0, len(hashes), AT_ONCE):
        least = np.minimum(least, ((hashes[None, start : start + AT_ONCE] ^ masks) * factors).min(1))
    return np.array([xxhash.xxh3_64_intdigest(m.tobytes(), k) for k, m in enumerate(least.reshape(bands, ROWS))], np.uint64).view(np.int64)


def similar(one: np.ndarray, other: np.ndarray) -> bool:
    """Whether two sets are similar enough."""
    part, whole = SIMILARITY
    if part * max(len(one), len(other)) > whole * min(len(one), len(other)):
        return False
    shared = len(np.intersect1d(one, other, assume_unique=True))
    return whole * shared >= part * (len(one) + len(other) - shared)


def _sizes_allow(one: Column, other: Column) -> Column:
    return SIMILARITY[0] * F.greatest(one, other) <= SIMILARITY[1] * F.least(one, other)


def _described(docs: DataFrame, shingle: int, id_col: str, text_col: str, bands: int) -> DataFrame:
    """``doc_id``, fingerprint ``fp``, ``name`` and size ``n`` of its set, the set's ``bands``, and ``text_hash``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps, sets = zip(*(described(t, shingle) for t in byte_values(batch.column(1))), strict=True)
            numbers = [np.array(fps, np.uint64).view(np.int64), [set_name(s) for s in sets], [len(s) for s in sets]]
            columns = [*(pa.array(x, pa.int64()) for x in numbers), pa.array([band_keys(s, bands) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], ["doc_id", "text_hash", "fp", "name", "n", "bands"])

    texts = with_text(docs, id_col, text_col, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, text_hash bigint, fp bigint, name bigint, n bigint, bands array<bigint>")


def _classed(rows: DataFrame, bucket: int) -> DataFrame:
    """``name`` of each set and ``band``, a key of a SimHash class that it is in."""
    spark = rows.sparkSession
    distinct = materialize(rows.select("fp").distinct(), "set-fingerprints")
    classes = simhash.classes(distinct, bucket)
    held = rows.select("name", "fp").distinct().join(classes, "fp").select("name", F.xxhash64(F.lit("simhash"), "root").alias("band")).distinct()
    held = materialize(held, "simhash-classes")
    remove(spark, classes)
    release_shuffles(spark)
    return held


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int, text_col: str) -> DataFrame:
    """``name`` and ``hashes`` of the sets of texts in ``wanted`` (text_hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t, shingle) for t in byte_values(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([set_name(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["name", "hashes"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    # A task sends a text on once, however many copies it has.
    own = docs.select(F.xxhash64(text).alias("text_hash"), text.alias("text")).groupBy("text_hash").agg(F.first("text").alias("text"))
    return own.join(wanted, "text_hash", "left_semi").select("text").mapInArrow(run, "name bigint, hashes binary")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (``u``, ``v``) whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            same = [similar(np.frombuffer(a.as_buffer(), "<u8"), np.frombuffer(b.as_buffer(), "<u8")) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(same, pa.bool_()))

    of = lambda k: sets.select(F.col("name").alias(k), F.col("hashes").alias(f"{k}_hashes"))
    return pairs.select("u", "v").join(of("u"), "u").join(of("v"), "v").select("u", "v", "u_hashes", "v_hashes").mapInArrow(run, "u bigint, v bigint")


def shared_counts(one: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of ``one`` (row) shares with each of ``other`` (column)."""
    sizes = [len(x) for x in (*one, *other)]
    values, column = np.unique(np.concatenate([*one, *other]) if sizes else np.zeros(0, np.uint64), return_inverse=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(one), len(other)), np.float32)
    for start in range(0, len(values), COLUMNS):
        part = slice(*np.searchsorted(column, [start, start + COLUMNS]))
        grid = np.zeros((len(sizes), min(COLUMNS, len(values) - start)), np.float32)
        grid[row[part], column[part] - start] = 1
        out += grid[: len(one)] @ grid[len(one) :].T
    return out.astype(np.int64)


def block_links(one: list[tuple], other: list[tuple]) -> list[tuple[int, int]]:
    """Links between two blocks of (name, root, set) that join all components that have a similar pair."""
    part, whole = SIMILARITY
    n, m = (np.array([len(x[2]) for x in side]) for side in (one, other))
    shared = shared_counts([x[2] for x in one], [x[2] for x in other])
    roots = [np.array([x[1] for x in side]) for side in (one, other)]
    alike = (whole * shared >= part * (n[:, None] + m[None, :] - shared)) & (roots[0][:, None] != roots[1][None, :])
    parent: dict[int, int] = {}

    def find(k: int) -> int:
        while parent.setdefault(k, k) != k:
            k = parent[k]
        return k

    out = []
    for i, j in zip(*np.nonzero(alike), strict=True):
        a, b = find(one[i][1]), find(other[j][1])
        if a != b:
            parent[a] = b
            out.append((one[i][0], other[j][0]))
    return out


def _across_blocks(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``u``, ``v``: links across components in large buckets (band, name, root, size)."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"))
    packed = dealt.join(sets, "name").groupBy("band", "block").agg(F.first("blocks").alias("blocks"), F.collect_list(F.struct("name", "root", "hashes")).alias("held"))
    meeting = packed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meeting = meeting.select("band", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "held")

    def compare(rows: pa.Table) -> pa.Table:
        sides = [[(x["name"], x["root"], np.frombuffer(x["hashes"], "<u8")) for x in held] for held in rows.column("held").to_pylist()]
        # A block meets itself once; where its partner is empty there is nothing to compare.
        found = block_links(sides[0], sides[-1]) if len(sides) == 2 or rows.column("low")[0] == rows.column("high")[0] else []
        return pa.table({"u": pa.array([x[0] for x in found], pa.int64()), "v": pa.array([x[1] for x in found], pa.int64())})

    return meeting.groupBy("band", "low", "high").applyInArrow(compare, "u bigint, v bigint")


def links(docs: DataFrame, distinct: DataFrame, classed: DataFrame, shingle: int = SHINGLE, text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """``u``, ``v``: links between distinct sets (name, n, text_hash, bands), by SimHash in classes (name, band), that connect all candidates that are similar."""
    keyed = distinct.select("name", "n", "text_hash", F.explode("bands").alias("band"))
    keyed = distinct.select("name", "n", "text_hash").join(classed, "name").unionByName(keyed)
    first = keyed.groupBy("band").agg(F.min(F.struct("name", "n")).alias("first"), F.max("name").alias("last")).filter("first.name <> last").select("band", "first")
    shared = materialize(keyed.join(first, "band"), "shared-bands")
    sets = materialize(_sets(docs, shared.select("text_hash").distinct(), shingle, text_col), "shingle-sets")
    release_shuffles(docs.sparkSession)
    star = shared.filter((F.col("name") != F.col("first.name")) & _sizes_allow(F.col("n"), F.col("first.n"))).select(F.col("name").alias("u"), F.col("first.name").alias("v")).distinct()
    star = materialize(star, "star-pairs")
    near = materialize(_verified(star, sets), "star-links")
    roots = components(near).select(F.col("node").alias("name"), "root")
    member = shared.select("band", "name", "n").join(roots, "name", "left").withColumn("root", F.coalesce("root", "name"))
    several = member.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size")).filter("low <> high").select("band", "size")
    left = materialize(member.join(several, "band"), "open-bands")
    small = left.filter(F.col("size") <= bucket)
    other = small.select("band", F.col("name").alias("v"), F.col("n").alias("v_n"), F.col("root").alias("v_root"))
    across = small.withColumnRenamed("name", "u").join(other, "band").filter((F.col("root") != F.col("v_root")) & (F.col("u") > F.col("v")) & _sizes_allow(F.col("n"), F.col("v_n")))
    far = materialize(_verified(across.select("u", "v").distinct().join(star, ["u", "v"], "left_anti"), sets), "far-links")
    large = materialize(_across_blocks(left.filter(F.col("size") > bucket).select("band", "name", "root", "size"), sets), "block-links")
    for done in (shared, sets, star, left):
        remove(docs.sparkSession, done)
    release_shuffles(docs.sparkSession)
    return near.unionByName(far).unionByName(large)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET, bands: int = BANDS) -> DataFrame:
    """``doc_id``, ``text_hash``, ``group`` (a key of the component) and ``component_id`` of each row.

    A component may have no identifier (all null), and one identifier may be in several (rows that repeat it), so
    a component is told by its ``group``.
    """
    rows = materialize(_described(docs, shingle, id_col, text_col, bands), "shingled")
    classed = _classed(rows, bucket)
    distinct = rows.groupBy("name").agg(F.min("doc_id").alias("least_id"), F.first("n").alias("n"), F.min("text_hash").alias("text_hash"), F.first("bands").alias("bands"))
    distinct = materialize(distinct, "distinct-sets")
    roots = components(links(docs, distinct, classed, shingle, text_col, bucket)).select(F.col("node").alias("name"), "root")
    named = distinct.select("name", "least_id").join(roots, "name", "left").select("name", "least_id", F.coalesce("root", "name").alias("root"))
    names = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = named.join(names, "root").select("name", F.col("root").alias("group"), "component_id")
    return rows.select("doc_id", "text_hash", "name").join(classes, "name").select("doc_id", "text_hash", "group", "component_id")
