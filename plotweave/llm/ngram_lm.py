"""Katz backoff trigram language model over a corpus, and scores of all its texts.

Tokens are words and an end after the last; the first follow two starts. The model:

* ``p(w | u, v) = d3(c) c(u, v, w) / c(u, v)`` if the trigram was seen, be it once, else ``alpha(u, v) p(w | v)``;
  ``p(w | v) = d2(c) c(v, w) / c(v)`` if the bigram was seen, else ``alpha(v) p(w)``; ``p(w) = d1(c) c(w) / N``, what
  discounting frees being the probability of an unknown word. A context that was never seen has ``alpha`` 1.
* ``d`` is the Good-Turing discount of counts up to ``KATZ_K``, of each order, from the counts of counts
  as they are where that gives a discount within (0, 1] for each count, else (copies make them irregular) from the
  counts of counts smoothed by a log-linear fit, as in simple Good-Turing (Gale and Sampson 1995). Only where
  that isn't possible either (a toy corpus) an absolute discount.
* ``alpha`` makes ``p(. | u, v)`` and ``p(. | v)`` sum to 1 exactly: what discounting leaves over what the
  seen followers have in the lower order. If nothing is left, one unit is added to the context's count.

The trigram counts are a table in the shared folder, partitioned by the middle word ``v`` of ``(u, v, w)``. All that a
probability needs lies in one partition: the contexts ``(u, v)``, the bigrams ``(v, w)``, which are sums of trigrams, and
``v`` with its followers; only ``p(w)`` comes from elsewhere, for frequent words from the lexicon, for
others by a join. Backoff weights are a function of a partition's counts, made when it is loaded. A token's probability is found
by the recursion: the trigram, else its context's weight and the bigram, else ``v``'s weight and the word.

Words are 64-bit hashes. The ``LEXICON`` most frequent ones have short codes; they are the only thing that is broadcast,
and this bounds it. Counting and scoring shuffle packed blobs: a map task merges the trigrams of ``BATCH_TOKENS``
tokens first, and deals them into buckets of about ``BUCKET_TOKENS`` tokens. A word with more than two buckets' tokens is
hot: it has as many buckets of its own as it fills, by ``u`` and ``w``, and the sums over its followers and contexts
are added up across them and given to each. (Of words beyond the lexicon none can be as frequent as those in it.)
A bucket's task holds its part of the model and streams blobs past it; sums come back to the documents of a batch.

Cases: a null or empty text is an end alone; a null identifier isn't held out; without training
documents every base count is 0 and every score that of unknown words; words of equal counts enter the lexicon in hash
order, which changes no score; repeated rows count and are scored each; very long texts are read whole, as a batch
of their own; an empty table gives an empty table. Only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import give_back, materialize, release_shuffles, remove, slices
from plotweave.llm.mph import mixed

KATZ_K = 5
#: Counts whose counts are known, for the log-linear fit.
COUNTS = 64
#: Words with codes of their own.
LEXICON = 1 << 18
#: Tokens that a map task merges at once, and of a bucket on average. A word with more than twice these is hot.
BATCH_TOKENS, BUCKET_TOKENS = 1 << 20, 1 << 20
#: Rows that are split into words at once.
ROWS_AT_ONCE = 256
#: No word contains a line feed, so these are no words' hashes.
START, END = (np.uint64(xxhash.xxh3_64_intdigest(s)) for s in (b"\nstart", b"\nend"))
START_CODE, END_CODE = 0, 1
END_ID = int(END.view(np.int64))
#: The code of a word that a bucket doesn't know; codes are 32-bit integers.
MISSING = 2**31 - 1
LEAST_LEFT = 1e-12
#: Sums travel as integers of this part of one.
UNIT = 2.0**-30


@dataclass
class Batch:
    """Tokens of some documents one after another, as places in ``hashes`` (distinct words, the end last)."""

    ids: list
    held: list[bool]
    lengths: np.ndarray
    hashes: np.ndarray
    words: np.ndarray

    @property
    def of(self) -> np.ndarray:
        """Whose each token is."""
        return np.repeat(np.arange(len(self.ids), dtype=np.int32), self.lengths)


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and how many each has. Blanks are those of ASCII, only A-Z is lower-cased."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = lists.flatten()
    some = pc.greater(pc.binary_length(words), 0)
    upto = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    ends = np.cumsum(pc.list_value_length(lists).to_numpy())
    return words.filter(some), np.diff(upto[ends], prepend=0)


def _lot(ids: list, held: list[bool], counts: list[np.ndarray], words: list[pa.Array]) -> Batch:
    coded = pa.concat_arrays(words).dictionary_encode()
    own = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
    hashes = np.array([*(xxhash.xxh3_64_intdigest(w) for w in own), int(END)], np.uint64)
    lengths = np.concatenate(counts).astype(np.int64) + 1
    places = np.full(int(lengths.sum()), len(own), np.int32)
    inside = np.ones(len(places), bool)
    inside[np.cumsum(lengths) - 1] = False
    places[inside] = coded.indices.to_numpy()
    return Batch(ids, held, lengths, hashes, places)


def _batched(batches: Iterator[pa.RecordBatch], train_only: bool) -> Iterator[Batch]:
    """Documents (id, text, held) in lots of about ``BATCH_TOKENS`` tokens."""
    ids, held, counts, words, total = [], [], [], [], 0
    for batch in slices(batches, ROWS_AT_ONCE):
        rows = batch.filter(pc.invert(batch.column(2))) if train_only else batch
        if not rows.num_rows:
            continue
        own, n = split(rows.column(1))
        ids += rows.column(0).to_pylist()
        held += rows.column(2).to_pylist()
        counts.append(n)
        words.append(own)
        total += len(own) + len(n)
        if total >= BATCH_TOKENS:
            yield _lot(ids, held, counts, words)
            ids, held, counts, words, total = [], [], [], [], 0
            give_back()
    if ids:
        yield _lot(ids, held, counts, words)


# ---- packed integers


#: Contexts of their own for each call would cost as much as what they do.
_ZIP, _UNZIP = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def planes(values: np.ndarray) -> bytes:
    """Integers compressed byte position by byte position, each by itself; positions of zeros cost nothing."""
    grid = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.dtype.itemsize).T)
    return _joined(len(values).to_bytes(4, "little"), *(_ZIP.compress(row) if row.any() else b"" for row in grid))


def unplanes(data: bytes, kind: str) -> np.ndarray:
    n, *rows = _parts(data)
    grid = np.zeros((len(rows), int.from_bytes(n, "little")), np.uint8)
    for own, row in zip(grid, rows, strict=True):
        if row:
            own[:] = np.frombuffer(_UNZIP.decompress(row), np.uint8)
    return np.ascontiguousarray(grid.T).reshape(-1).view(kind)


def _joined(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def _parts(blob: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 4], "little")
        out.append(blob[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def _steps(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Differences to the value before, but the value itself where ``starts`` says so."""
    out = np.diff(values, prepend=values[:1])
    out[starts] = values[starts]
    return out.astype("<u4")


def _sums(steps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The inverse of ``_steps``. Sums run over 32 bits, but differences of them are right."""
    total = np.cumsum(steps, dtype=np.uint32)
    at = np.flatnonzero(starts)
    return (total - np.repeat(total[at] - steps[at], np.diff(at, append=len(steps)))).astype(np.int32)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where one of the columns differs from the row before."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def pack(v: np.ndarray, u: np.ndarray, w: np.ndarray, rare: np.ndarray, known: int) -> list[bytes]:
    """Trigrams in order as small steps; codes from ``known`` up are places in ``rare`` (hashes in order), of which only those that occur are kept."""
    beyond = [np.flatnonzero(x >= known) for x in (v, u, w)]
    seen = np.zeros(len(rare), bool)
    for x, at in zip((v, u, w), beyond, strict=True):
        seen[x[at] - known] = True
    used = np.flatnonzero(seen)
    v, u, w = (x.copy() for x in (v, u, w))
    for x, at in zip((v, u, w), beyond, strict=True):
        x[at] = known + np.searchsorted(used, x[at] - known)
    by_v, by_u = _changes(v), _changes(v, u)
    return [planes(np.diff(rare[used], prepend=np.uint64(0))), planes(_steps(v, np.arange(len(v)) == 0)), planes(_steps(u, by_v)), planes(_steps(w, by_u))]


def unpack(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rare hashes, and ``v``, ``u``, ``w``."""
    rare = np.cumsum(unplanes(parts[0], "<u8"))
    steps = [unplanes(p, "<u4") for p in parts[1:4]]
    v = np.cumsum(steps[0], dtype=np.int32)
    by_v = _changes(v)
    u = _sums(steps[1], by_v)
    return rare, v, u, _sums(steps[2], by_v | _changes(u))


# ---- lexicon and words


def discounts(n: Mapping[int, int], k: int = KATZ_K) -> list[float]:
    """``d`` by count, 0 to ``k``; ``n`` has the number of types of each count, up to ``COUNTS``."""

    def turing(f: Mapping[int, float]) -> list[float] | None:
        a = (k + 1) * f[k + 1] / f[1]
        d = [((r + 1) * f[r + 1] / f[r] / r - a) / (1 - a) for r in range(1, k + 1)] if a < 1 else []
        return [0.0, *d] if d and all(0 < x <= 1 for x in d) else None

    if all(n.get(r) for r in range(1, k + 2)) and (raw := turing(n)):
        return raw
    seen = sorted(r for r in range(1, COUNTS + 1) if n.get(r))
    if len(seen) > 1:
        # Where counts have gaps, a count stands for those around it.
        gaps = [((seen[i + 1] if i + 1 < len(seen) else 2 * r - seen[i - 1]) - (seen[i - 1] if i else 0)) / 2 for i, r in enumerate(seen)]
        slope = np.polyfit(np.log(seen), np.log([n[r] / g for r, g in zip(seen, gaps, strict=True)]), 1)[0]
        if smooth := turing({r: float(r) ** slope for r in range(1, k + 2)}):
            return smooth
    less = n[1] / (n[1] + 2 * n[2]) if n.get(1) and n.get(2) else 0.5
    return [0.0, *((r - less) / r for r in range(1, k + 1))]


def discounted(count: np.ndarray, d: list[float]) -> np.ndarray:
    """``d(c) * c``."""
    return np.where(count < len(d), np.array(d)[np.minimum(count, len(d) - 1)], 1.0) * count


@dataclass(frozen=True)
class Words:
    """What the driver knows of the words: a few numbers."""

    total: int
    types: int
    d: list[float]
    scale: float
    unknown: float

    def p(self, count: np.ndarray) -> np.ndarray:
        """Probabilities by count, an unknown word's where it is 0."""
        return np.where(count > 0, discounted(count, self.d) * self.scale, self.unknown)


def word_counts(docs: DataFrame) -> DataFrame:
    """``h``, ``c`` of words in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _batched(batches, True):
            c = np.bincount(lot.words, minlength=len(lot.hashes))
            yield pa.RecordBatch.from_arrays([pa.array(lot.hashes.view(np.int64)), pa.array(c)], ["h", "c"])

    return docs.mapInArrow(run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


def _counts_of(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """By count up to ``COUNTS + 1`` (which stands for all above): types and tokens."""
    found = rows.groupBy(F.least("c", F.lit(COUNTS + 1)).alias("r")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("t")).collect()  # COUNTS + 1 rows at most
    return {r.r: (r.n, r.t) for r in found}


def word_model(counts: DataFrame) -> Words:
    by_count = _counts_of(counts)
    total, types = sum(t for _, t in by_count.values()), sum(n for n, _ in by_count.values())
    d = discounts({r: n for r, (n, _) in by_count.items() if r <= COUNTS})
    if not total:
        return Words(0, 0, d, 1.0, 1.0)
    freed = sum((1 - d[r]) * t for r, (_, t) in by_count.items() if r <= KATZ_K)
    if freed / total < LEAST_LEFT:
        return Words(total, types, [0.0, *[1.0] * KATZ_K], 1 / (total + 1), 1 / (total + 1))
    return Words(total, types, d, 1 / total, freed / total)


@dataclass(frozen=True)
class Lexicon:
    """The most frequent words by code, start and end first; and how middle words are dealt into buckets.

    A hot word has ``splits`` buckets from ``first`` on. What is left of it after discounting is known here.
    """

    hashes: np.ndarray
    counts: np.ndarray
    order: np.ndarray  # codes in the order of their hashes
    cold: int
    first: np.ndarray
    splits: np.ndarray
    log_alpha: np.ndarray
    shrink: np.ndarray

    @property
    def size(self) -> int:
        return len(self.hashes)

    @property
    def buckets(self) -> int:
        return self.cold + int(self.splits.sum())

    def hot(self) -> list[tuple[int, int]]:
        """Each bucket of a hot word, and its code."""
        return [(int(self.first[k]) + i, int(k)) for k in np.flatnonzero(self.splits) for i in range(self.splits[k])]

    def codes(self, hashes: np.ndarray, rare: np.ndarray) -> np.ndarray:
        """Codes of words; those beyond the lexicon by their place in ``rare`` (in order), else ``MISSING``."""
        own = self.hashes[self.order]
        at = np.minimum(np.searchsorted(own, hashes), len(own) - 1)
        out = np.where(own[at] == hashes, self.order[at], MISSING)
        if len(rare):
            place = np.minimum(np.searchsorted(rare, hashes), len(rare) - 1)
            out = np.where((out == MISSING) & (rare[place] == hashes), self.size + place, out)
        return out

    def dealt(self, v: np.ndarray, u: np.ndarray, w: np.ndarray, rare: np.ndarray) -> np.ndarray:
        """Buckets of trigrams."""
        hashes = np.concatenate([self.hashes, rare])
        out = ((hashes[v] >> np.uint64(32)) * np.uint64(self.cold) >> np.uint64(32)).astype(np.int32)
        hot = np.flatnonzero(self.splits[np.minimum(v, self.size - 1)] * (v < self.size))
        if len(hot):
            own = v[hot]
            out[hot] = self.first[own] + (mixed(hashes[u[hot]], hashes[w[hot]], 1) % self.splits[own].astype(np.uint64)).astype(np.int64)
        return out


def lexicon(counts: DataFrame, summary: Words) -> Lexicon:
    # LEXICON rows at most come to the driver.
    top = counts.filter(F.col("h") != END_ID).orderBy(F.desc("c"), "h").limit(LEXICON).toArrow()
    ends = counts.filter(F.col("h") == END_ID).collect()
    docs = ends[0].c if ends else 0
    hashes = np.concatenate([[START, END], top.column("h").to_numpy().view(np.uint64)]).astype(np.uint64)
    # A start is a context as often as there are documents.
    own = np.concatenate([[docs, docs], top.column("c").to_numpy()]).astype(np.int64)
    splits = np.where(own > 2 * BUCKET_TOKENS, -(-own // BUCKET_TOKENS), 0)
    splits[END_CODE] = 0  # nothing follows an end
    cold = max(1, -(-(summary.total - int(own[splits > 0].sum())) // BUCKET_TOKENS))
    return Lexicon(hashes, own, np.argsort(hashes), cold, cold + np.cumsum(splits) - splits, splits, np.zeros(len(own)), np.ones(len(own)))


# ---- trigrams of a batch


def ranked(v: np.ndarray, u: np.ndarray, w: np.ndarray, with_order: bool = True) -> tuple[np.ndarray | None, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """An order of trigrams by ``v``, ``u``, ``w`` (if it is wanted), where in it a new one starts, and the distinct ones."""
    bits = int(max(x.max(initial=0) for x in (v, u, w))).bit_length()
    if 3 * bits > 64:
        order = np.lexsort((w, u, v))
        new = _changes(v[order], u[order], w[order])
        at = order[new]
        return order, new, (v[at], u[at], w[at])
    one, two = np.uint64(bits), np.uint64(2 * bits)
    key = v.astype(np.uint64) << two | u.astype(np.uint64) << one | w.astype(np.uint64)
    order = np.argsort(key) if with_order else None
    key = key[order] if with_order else np.sort(key)
    new = _changes(key)
    key, mask = key[new], np.uint64((1 << bits) - 1)
    return order, new, ((key >> two).astype(np.int32), (key >> one & mask).astype(np.int32), (key & mask).astype(np.int32))


@dataclass
class Grams:
    """A batch's distinct trigrams by bucket and in order, how often each occurs, and in which documents (rising), one after another."""

    bucket: np.ndarray
    v: np.ndarray
    u: np.ndarray
    w: np.ndarray
    runs: np.ndarray
    docs: np.ndarray
    rare: np.ndarray

    def slices(self) -> Iterator[tuple[int, slice, slice]]:
        """Each bucket with its trigrams and their documents."""
        starts = np.flatnonzero(_changes(self.bucket))
        upto = np.concatenate([[0], np.cumsum(self.runs)])
        for a, b in zip(starts, [*starts[1:], len(self.bucket)], strict=True):
            yield int(self.bucket[a]), slice(int(a), int(b)), slice(int(upto[a]), int(upto[b]))


def grams(lot: Batch, lex: Lexicon, with_docs: bool) -> Grams:
    by_hash = np.argsort(lot.hashes)
    hashes = lot.hashes[by_hash]
    found = lex.codes(hashes, hashes[:0])
    beyond = found == MISSING
    rare = hashes[beyond]
    found[beyond] = lex.size + np.arange(len(rare))
    code = np.empty(len(hashes), np.int32)
    code[by_hash] = found
    w = code[lot.words]
    starts = np.cumsum(lot.lengths) - lot.lengths
    v, u = np.empty_like(w), np.empty_like(w)
    v[1:], v[starts] = w[:-1], START_CODE
    u[1:], u[starts] = v[:-1], START_CODE
    order, new, (v, u, w) = ranked(v, u, w, with_docs)
    at = np.flatnonzero(new)
    runs = np.diff(at, append=len(new))
    docs = np.sort((np.cumsum(new) << 32) | lot.of[order]) & 0xFFFFFFFF if with_docs else None
    bucket = lex.dealt(v, u, w, rare)
    deal = np.argsort(bucket, kind="stable")
    runs, at = runs[deal], at[deal]
    if with_docs:
        docs = docs[np.repeat(at - np.cumsum(runs) + runs, runs) + np.arange(len(docs))]
    return Grams(bucket[deal], v[deal], u[deal], w[deal], runs, docs, rare)


# ---- rows of the tables that are dealt into buckets

#: Kinds of rows, in the order in which a bucket's task reads them; then what counting gives besides.
RARE, FOLLOW, CONTEXT, GRAMS, HEAD, TEXTS, WANTED, BIGRAMS_OF, TRIGRAMS_OF = range(9)
#: ``h`` is a word's hash, a batch's name or a count, ``c`` a count.
ROWS = "bucket int, kind int, h bigint, c bigint, blob binary"
_NAMES = ["bucket", "kind", "h", "c", "blob"]


def _blobs(bucket: int, kind: int, h: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), pa.array([h], pa.int64()), pa.array([0], pa.int64()), pa.array([blob], pa.binary())], _NAMES)


def _flat(bucket: int, kind: int, h: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    n = len(h)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, bucket, np.int32)), pa.array(np.full(n, kind, np.int32)), pa.array(h.view(np.int64)), pa.array(c.astype(np.int64)), pa.nulls(n, pa.binary())], _NAMES)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """Rows of one bucket and kind after another, as slices."""
    for batch in batches:
        bucket, kind = (batch.column(k).to_numpy() for k in (0, 1))
        starts = np.flatnonzero(_changes(bucket, kind))
        for a, b in zip(starts, [*starts[1:], len(bucket)], strict=True):
            yield int(bucket[a]), int(kind[a]), batch.slice(int(a), int(b - a))


def _dealt(rows: DataFrame, lex: Lexicon, *more: str) -> DataFrame:
    return rows.repartitionById(lex.buckets, "bucket").sortWithinPartitions("bucket", "kind", *more)


def _packed(rows: DataFrame, lex: Lexicon) -> DataFrame:
    """Rows (bucket, kind, h, c, used, lower) as blobs of their buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, kind, found in _runs(batches):
            h, c, *sums = (found.column(k).to_numpy(zero_copy_only=False) for k in range(2, 6))
            yield _blobs(bucket, kind, 0, _joined(planes(np.diff(h.view(np.uint64), prepend=np.uint64(0))), planes(c.astype("<i8")), *(x.astype("<f8").tobytes() for x in sums if kind == CONTEXT)))

    return _dealt(rows.select("bucket", "kind", "h", "c", "used", "lower"), lex, "h").mapInArrow(run, ROWS)


def _unpacked(blobs: list[list[bytes]]) -> list[np.ndarray]:
    """Hashes, counts and, of contexts, both sums."""
    found = [[np.cumsum(unplanes(b[0], "<u8")), unplanes(b[1], "<i8"), *(np.frombuffer(x, "<f8") for x in b[2:])] for b in blobs]
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.uint64), np.zeros(0, np.int64)]


# ---- counting


def _in_bucket(code: np.ndarray, size: int, own: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """Codes of a blob (whose rare words are ``own``) as those of a bucket (``rare``); unknown words are ``MISSING``."""
    if not len(own):
        return code
    at = np.minimum(np.searchsorted(rare, own), max(0, len(rare) - 1))
    place = (np.where(rare[at] == own, size + at, MISSING) if len(rare) else np.full(len(own), MISSING)).astype(np.int32)
    beyond = code >= size
    out = code.copy()
    out[beyond] = place[code[beyond] - size]
    return out


def _narrowed(counts: np.ndarray) -> np.ndarray:
    """Counts in 32 bits where all of them fit; sums of both kinds are made in 64."""
    return counts.astype(np.uint32) if counts.max(initial=0) < 1 << 32 else counts


def merged(blobs: list[list[bytes]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One table of trigrams and counts from several: the rare words, ``v``, ``u``, ``w``, counts."""
    found = [(*unpack(b), _narrowed(unplanes(b[4], "<i8"))) for b in blobs]
    rare = np.unique(np.concatenate([f[0] for f in found]))
    v, u, w = (np.concatenate([_in_bucket(f[k], size, f[0], rare) for f in found]) for k in (1, 2, 3))
    c = np.concatenate([f[4] for f in found])
    del found
    if len(blobs) == 1:
        return rare, v, u, w, c.astype(np.int64)
    order, new, found = ranked(v, u, w)
    return rare, *found, np.add.reduceat(c[order], np.flatnonzero(new), dtype=np.int64)


def both(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Two codes as one key."""
    return first.astype(np.int64) << 32 | second


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the sums of their counts, and where each given key is among them."""
    order = np.argsort(keys)
    keys = keys[order]
    new = _changes(keys)
    at, back = np.flatnonzero(new), np.empty(len(keys), np.int64)
    back[order] = np.cumsum(new) - 1
    return keys[at], np.add.reduceat(counts[order], at) if len(at) else counts[:0], back


def trigram_counts(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """Rows of each bucket: its trigrams with counts (``GRAMS``), the rare words whose counts it wants, counts of counts, and followers of a hot word."""
    shared = docs.sparkSession.sparkContext.broadcast(lex)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        for lot in _batched(batches, True):
            g = grams(lot, lex, False)
            for bucket, own, _ in g.slices():
                yield _blobs(bucket, GRAMS, 0, _joined(*pack(g.v[own], g.u[own], g.w[own], g.rare, lex.size), planes(g.runs[own].astype("<i8"))))

    def counted(bucket: int, blobs: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        rare, v, u, w, c = merged(blobs, lex.size)
        yield _blobs(bucket, GRAMS, 0, _joined(*pack(v, u, w, rare, lex.size), planes(c.astype("<i8"))))
        counts = np.arange(1, COUNTS + 1)
        yield _flat(bucket, TRIGRAMS_OF, counts, np.bincount(np.minimum(c, COUNTS + 1), minlength=COUNTS + 2)[1 : COUNTS + 1])
        pairs, n, _ = summed(both(v, w), c)
        if bucket >= lex.cold:
            hashes = np.concatenate([lex.hashes, rare])
            yield _flat(bucket, FOLLOW, hashes[pairs & 0xFFFFFFFF], n)
        else:
            yield _flat(bucket, BIGRAMS_OF, counts, np.bincount(np.minimum(n, COUNTS + 1), minlength=COUNTS + 2)[1 : COUNTS + 1])
            wanted = rare[np.unique(w[w >= lex.size]) - lex.size]
            yield _flat(bucket, WANTED, wanted, np.zeros(len(wanted)))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, blobs = None, []
        for bucket, _, rows in _runs(batches):
            if bucket != held and blobs:
                yield from counted(held, blobs)
                blobs = []
                give_back()
            held = bucket
            blobs += [_parts(b.as_py()) for b in rows.column(4)]
        if blobs:
            yield from counted(held, blobs)

    return _dealt(docs.mapInArrow(emit, ROWS), lex).mapInArrow(merge, ROWS)


# ---- a bucket's part of the model


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted ``keys``, and whether they are right."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _added(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(values) else values[:0]


def _weights(used: np.ndarray, lower: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the backoff weights, and the factors of the seen followers; from the sums of their discounted shares and of their lower probabilities."""
    shrink = np.where(1 - used < LEAST_LEFT, count / (count + 1.0), 1.0)
    return np.log10((1 - used * shrink) / np.maximum(1 - lower, LEAST_LEFT)), shrink


class Part:
    """Trigrams, contexts, bigrams and middle words of a bucket, with what each adds to a token's log10 probability.

    What trigrams and bigrams add is over the word's own, which is added where the word is the middle one.
    """

    def __init__(self, lex: Lexicon, words: Words, d2: list[float], d3: list[float], bucket: int, blobs: dict[int, list[list[bytes]]]):
        self.lex, self.words = lex, words
        none, is_hot = np.zeros(0, np.int64), bucket >= lex.cold
        own, v, u, w, c = merged(blobs[GRAMS], lex.size) if blobs.get(GRAMS) else (none.view(np.uint64), *[none] * 4)
        (told, told_c), follow, context = (_unpacked(blobs.get(k, [])) for k in (RARE, FOLLOW, CONTEXT))
        rare = np.unique(np.concatenate([own, told, context[0]])) if is_hot else own
        if is_hot:
            rare = rare[lex.codes(rare, none.view(np.uint64)) == MISSING]
        self.rare = rare
        v, u, w = (_in_bucket(x, lex.size, own, rare) for x in (v, u, w))
        rare_c = np.zeros(len(rare), np.int64)
        at, right = _find(rare, told)
        rare_c[at[right]] = told_c[right]
        counts = np.concatenate([lex.counts, rare_c])
        pair = both(v, w)
        if is_hot:
            # Sums over all the word's buckets are given.
            hot = next(int(k) for k in np.flatnonzero(lex.splits) if lex.first[k] <= bucket < lex.first[k] + lex.splits[k])
            follower = lex.codes(follow[0], rare)
            order = np.argsort(follower)
            self.pairs, n2 = hot << 32 | follower[order], follow[1][order]
            self.middles, self.middle_c = np.array([hot]), lex.counts[[hot]]
            self.middle_alpha, shrink = lex.log_alpha[[hot]], lex.shrink[[hot]]
            of = np.zeros(len(n2), np.int64)
            g = discounted(n2, d2) / self.middle_c[of]
        else:
            self.pairs, n2, of_pair = summed(pair, c)
            starts = np.flatnonzero(_changes(self.pairs >> 32))
            self.middles, self.middle_c = (self.pairs >> 32)[starts], _added(n2, starts)
            of = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(n2)))
            g = discounted(n2, d2) / self.middle_c[of]
        p1 = words.p(counts[self.pairs & 0xFFFFFFFF])
        if not is_hot:
            self.middle_alpha, shrink = _weights(_added(g, starts), _added(p1, starts), self.middle_c)
        self.p2 = p2 = g * shrink[of]
        self.pair_adds = np.log10(p2) - np.log10(p1)
        at = _find(self.pairs, pair)[0] if is_hot else of_pair
        starts = np.flatnonzero(_changes(v, u))
        self.contexts = both(v[starts], u[starts])
        self.shares = _added(c, starts), _added(discounted(c, d3), starts), _added(p2[at], starts)
        if len(context) > 2:
            code = lex.codes(context[0], rare)
            order = np.argsort(code)
            self.contexts, (context_c, used, lower) = hot << 32 | code[order], (x[order] for x in context[1:])
        else:
            context_c, used, lower = self.shares
        self.context_adds, shrink = _weights(used / context_c, lower, context_c)
        of = _find(self.contexts, both(v, u))[0] if len(context) > 2 else np.cumsum(_changes(v, u)) - 1
        # Where the three codes fit into one key, a trigram is found without its context.
        self.bits = (lex.size + len(rare)).bit_length()
        self.trigrams = self._keys(v, u, w, of)
        self.trigram_adds = np.log10(discounted(c, d3) / context_c[of] * shrink[of]) - np.log10(p1[at]) if len(v) else np.zeros(0)

    def _keys(self, v: np.ndarray, u: np.ndarray, w: np.ndarray, context: np.ndarray) -> np.ndarray:
        return v.astype(np.int64) << 2 * self.bits | u.astype(np.int64) << self.bits | w if 3 * self.bits < 64 else both(context, w)

    def adds(self, v: np.ndarray, u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each trigram: what it adds to the score, and the count of its middle word if that is beyond the lexicon (else -1).

        Words of the lexicon have their own share added where they are read.
        """
        pick = lambda values, at, found, rest=0.0: np.where(found, values[at], rest) if len(values) else np.full(len(found), rest)
        seen = (v != MISSING) & (u != MISSING) & (w != MISSING)
        context = has_context = None
        if 3 * self.bits >= 64:
            context, has_context = _find(self.contexts, both(v, u))
            seen &= has_context
        trigram, found = _find(self.trigrams, self._keys(*(np.where(seen, x, 0) for x in (v, u, w)), context))
        found &= seen
        score = pick(self.trigram_adds, trigram, found)
        rest = np.flatnonzero(~found)
        if len(rest):
            v_, u_, w_ = v[rest], u[rest], w[rest]
            middle, known = _find(self.middles, v_)
            pair, has_pair = _find(self.pairs, both(v_, w_))
            context, has_context = _find(self.contexts, both(v_, u_))
            score[rest] = pick(self.context_adds, context, has_context) + np.where(has_pair, pick(self.pair_adds, pair, has_pair), pick(self.middle_alpha, middle, known))
        count = np.full(len(v), -1)
        own = np.flatnonzero(v >= self.lex.size)
        if len(own):
            middle, known = _find(self.middles, v[own])
            count[own] = pick(self.middle_c, middle, known, 0)
            score[own] += np.log10(self.words.p(count[own]))
        return score, count


# ---- training


@dataclass(frozen=True)
class Model:
    """``tables``: the rows of all buckets (trigram counts, and what a bucket needs from elsewhere)."""

    words: Words
    d2: list[float]
    d3: list[float]
    lexicon: Lexicon
    tables: DataFrame


def train(docs: DataFrame) -> Model:
    """Fit on the rows of ``docs`` (doc_id, text, held) that aren't held."""
    spark = docs.sparkSession
    counts = materialize(word_counts(docs), "lm-words")
    summary = word_model(counts)
    lex = lexicon(counts, summary)
    found = materialize(trigram_counts(docs, lex), "lm-trigrams")
    release_shuffles(spark)
    types = found.filter(F.col("kind") >= BIGRAMS_OF).groupBy("kind", "h").agg(F.sum("c").alias("n")).collect()  # 2 * COUNTS rows
    of = {k: {r.h: r.n for r in types if r.kind == k} for k in (BIGRAMS_OF, TRIGRAMS_OF)}
    d3 = discounts(of[TRIGRAMS_OF])
    rare = found.filter(F.col("kind") == WANTED).select("bucket", "h").join(counts, "h")
    none = F.lit(None).cast("double")
    row = lambda rows, kind, used=none, lower=none: rows.select("bucket", F.lit(kind).alias("kind"), "h", "c", used.alias("used"), lower.alias("lower"))
    tables = found.filter(F.col("kind") == GRAMS).unionByName(materialize(_packed(row(rare, RARE), lex), "lm-rare"))
    if not lex.splits.any():
        remove(spark, counts)
        release_shuffles(spark)
        return Model(summary, discounts(of[BIGRAMS_OF]), d3, lex, tables)
    # Hot words: followers and contexts summed over all buckets of a word, and given to each.
    own = materialize(spark.createDataFrame(lex.hot(), "bucket int, word int"), "lm-hot-buckets")
    follow = materialize(found.filter(F.col("kind") == FOLLOW).select("bucket", "h", "c").join(own, "bucket").groupBy("word", "h").agg(F.sum("c").alias("c")), "lm-followers")
    for r, (n, _) in _counts_of(follow).items():
        if r <= COUNTS:
            of[BIGRAMS_OF][r] = of[BIGRAMS_OF].get(r, 0) + n
    d2 = discounts(of[BIGRAMS_OF])
    follow_c = follow.join(counts.withColumnRenamed("c", "n"), "h")
    lex = _hot_weights(lex, follow_c, summary, d2)
    # A hot word's followers and their own counts go to all its buckets.
    given = follow_c.join(own, "word")
    followers = materialize(_packed(row(given, FOLLOW).unionByName(row(given.drop("c").withColumnRenamed("n", "c"), RARE)), lex), "lm-hot")
    hot = found.filter((F.col("kind") == GRAMS) & (F.col("bucket") >= lex.cold)).unionByName(followers)
    sums = _context_sums(hot, lex, summary, d2, d3).join(own, "bucket").groupBy("word", "h").agg(F.sum("c").alias("c"), F.sum("used").alias("used"), F.sum("lower").alias("lower"))
    contexts = materialize(_packed(row(sums.join(own, "word"), CONTEXT, F.col("used"), F.col("lower")), lex), "lm-contexts")
    for done in (counts, own, follow):
        remove(spark, done)
    release_shuffles(spark)
    return Model(summary, d2, d3, lex, tables.unionByName(followers).unionByName(contexts))


def _hot_weights(lex: Lexicon, followers: DataFrame, words: Words, d2: list[float]) -> Lexicon:
    """The lexicon with the backoff weights of hot words; ``followers`` has word, h, c and the follower's own count n."""

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, n = (batch.column(k).to_numpy() for k in (1, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(discounted(c, d2).astype(np.float64)), pa.array(words.p(n))], ["word", "used", "lower"])

    sums = followers.select("word", "c", "n").mapInArrow(shares, "word int, used double, lower double").groupBy("word").agg(F.sum("used").alias("used"), F.sum("lower").alias("lower")).collect()  # hot words: part of the lexicon
    log_alpha, shrink = lex.log_alpha.copy(), lex.shrink.copy()
    for r in sums:
        a, s = _weights(np.array([r.used / lex.counts[r.word]]), np.array([r.lower]), lex.counts[[r.word]])
        log_alpha[r.word], shrink[r.word] = a[0], s[0]
    return replace(lex, log_alpha=log_alpha, shrink=shrink)


def _context_sums(hot: DataFrame, lex: Lexicon, words: Words, d2: list[float], d3: list[float]) -> DataFrame:
    """``bucket``, ``h`` (a context's first word), and sums over its trigrams in that bucket: ``c``, ``used`` (discounted), ``lower`` (bigram probabilities)."""
    shared = hot.sparkSession.sparkContext.broadcast(lex)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, part, _ in _loaded(batches, shared.value, words, d2, d3, always=True):
            hashes = np.concatenate([shared.value.hashes, part.rare])[part.contexts & 0xFFFFFFFF]
            c, used, lower = part.shares
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), bucket, np.int32)), pa.array(hashes.view(np.int64)), pa.array(c), pa.array(used.astype(np.float64)), pa.array(lower)], ["bucket", "h", "c", "used", "lower"])

    return _dealt(hot, lex).mapInArrow(sums, "bucket int, h bigint, c bigint, used double, lower double")


def _loaded(batches: Iterator[pa.RecordBatch], lex: Lexicon, words: Words, d2: list[float], d3: list[float], always: bool = False) -> Iterator[tuple[int, Part | None, tuple[int, int, bytes] | None]]:
    """Each bucket's part with each of the rows (kind, name, blob) that go past it; with ``always`` also, once, that of a bucket without such rows."""
    held, blobs, part = None, {}, None
    for bucket, kind, found in _runs(batches):
        if bucket != held:
            if always and held is not None and part is None:
                yield held, Part(lex, words, d2, d3, held, blobs), None
            held, blobs, part = bucket, {}, None
            give_back()
        if kind <= GRAMS:
            blobs.setdefault(kind, []).extend(_parts(b.as_py()) for b in found.column(4))
            continue
        for k in range(found.num_rows):
            if kind != HEAD and part is None:
                part, blobs = Part(lex, words, d2, d3, bucket, blobs), {}
            yield bucket, part, (kind, found.column(2)[k].as_py(), found.column(4)[k].as_py())
    if always and held is not None and part is None:
        yield held, Part(lex, words, d2, d3, held, blobs), None


def ngrams(model: Model) -> DataFrame:
    """``h1``, ``h2``, ``h3``, ``c``: the trigram counts as plain rows (hashes; ``START`` before the first word)."""
    shared = model.tables.sparkSession.sparkContext.broadcast(model.lexicon)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                parts = _parts(blob.as_py())
                rare, v, u, w = unpack(parts)
                hashes = np.concatenate([shared.value.hashes, rare]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(hashes[x]) for x in (u, v, w)] + [pa.array(unplanes(parts[4], "<i8"))], ["h1", "h2", "h3", "c"])

    return model.tables.filter(F.col("kind") == GRAMS).select("blob").mapInArrow(rows, "h1 bigint, h2 bigint, h3 bigint, c bigint")


# ---- scoring


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``base`` and ``score`` of each row of ``docs`` (doc_id, text, held).

    ``base`` is the sum of log10(c + 1).
    """
    lex, words, d2, d3 = model.lexicon, model.words, model.d2, model.d3
    shared = docs.sparkSession.sparkContext.broadcast(lex)
    # What a word adds by itself: its probability, its base and whether it is known.
    own_score, own_base = np.log10(words.p(lex.counts)), np.log10(lex.counts + 1.0)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        task = TaskContext.get().partitionId()
        for number, lot in enumerate(_batched(batches, False)):
            name = task << 24 | number
            code = lex.codes(lot.hashes, lot.hashes[:0])
            inside = code != MISSING
            code = np.where(inside, code, 0)
            of = lot.of
            add = lambda x, of=of, lot=lot, inside=inside: np.bincount(of, np.where(inside, x, 0.0)[lot.words], len(lot.ids))
            own = [add(own_score[code]), add(own_base[code]), add(lex.counts[code] > 0)]
            head = pa.record_batch([pa.array(lot.ids, pa.int64()), pa.array(lot.held, pa.bool_()), pa.array(lot.lengths), *map(pa.array, own)], ["doc_id", "held", "n", "score", "base", "known"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, head.schema) as out:
                out.write_batch(head)
            yield _blobs(name % lex.buckets, HEAD, name, sink.getvalue().to_pybytes())
            g = grams(lot, lex, True)
            for bucket, own, their in g.slices():
                starts = np.zeros(their.stop - their.start, bool)
                starts[np.cumsum(g.runs[own]) - g.runs[own]] = True
                yield _blobs(bucket, TEXTS, name, _joined(*pack(g.v[own], g.u[own], g.w[own], g.rare, lex.size), planes(g.runs[own].astype("<u4")), planes(_steps(g.docs[their], starts))))

    def sums(part: Part, blob: bytes) -> bytes:
        """Documents in order, and what the bucket adds to each."""
        parts = _parts(blob)
        rare, *codes = unpack(parts)
        runs = unplanes(parts[4], "<u4").astype(np.int64)
        starts = np.zeros(int(runs.sum()), bool)
        starts[np.cumsum(runs) - runs] = True
        score, count = part.adds(*(_in_bucket(x, part.lex.size, rare, part.rare) for x in codes))
        docs = _sums(unplanes(parts[5], "<u4"), starts)
        of = np.flatnonzero(np.bincount(docs))
        add = lambda x: np.bincount(docs, np.repeat(x, runs))[of]
        fixed = lambda x: planes(np.rint(x / UNIT).astype("<i8"))
        return _joined(planes(np.diff(of, prepend=0).astype("<u4")), fixed(add(score)), fixed(add(np.log10(np.maximum(count, 0) + 1.0))), planes(add(count > 0).astype("<u4")))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, part, row in _loaded(batches, shared.value, words, d2, d3):
            if row is not None:
                kind, name, blob = row
                yield _blobs(bucket, kind, name, blob if kind == HEAD else sums(part, blob))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, head, added = None, None, []

        def finished() -> pa.RecordBatch:
            score, base, known = (head.column(k).to_numpy() for k in (3, 4, 5))
            return pa.RecordBatch.from_arrays([head.column(0), head.column(1), head.column(2), pa.array(np.rint(known).astype(np.int64) + added[2]), pa.array(base + added[1] * UNIT), pa.array(score + added[0] * UNIT)], ["doc_id", "held_out", "n_tokens", "n_known", "base", "score"])

        for batch in batches:
            for kind, name, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(4), strict=True):
                if name != held:
                    if head is not None:
                        yield finished()
                    held, head = name, None
                if kind == HEAD:
                    with pa.ipc.open_stream(blob.as_py()) as stream:
                        head = stream.read_next_batch()
                    added = [np.zeros(head.num_rows, np.int64) for _ in range(3)]
                else:
                    of, *values = _parts(blob.as_py())
                    of = np.cumsum(unplanes(of, "<u4"), dtype=np.int64)
                    for k, (x, form) in enumerate(zip(values, ("<i8", "<i8", "<u4"), strict=True)):
                        added[k][of] += unplanes(x, form).astype(np.int64)
        if head is not None:
            yield finished()

    rows = docs.mapInArrow(emit, ROWS).unionByName(model.tables)
    sums_back = _dealt(rows, lex).mapInArrow(look_up, ROWS).repartition("h").sortWithinPartitions("h", "kind")
    return sums_back.mapInArrow(total, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double")


def prepared(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The three columns that ``train`` and ``score`` take."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(held, F.lit(False)).alias("held"))
