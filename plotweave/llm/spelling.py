"""Spelling variants: words at one edit from each other, each led to its frequent form.

Near words are joined by a rare-first q-gram prefix filter (Xiao et al. 2008) over bigrams:

1. Count: words and their occurrences; only words found twice or more go on.
2. Order: bigrams by the number of places they have in words, rarest first. One edit destroys two bigrams of a
   word at most, so of the three rarest places (ties: the leftmost) of one word at least one is
   among the three rarest of the other too, at the same position, or shifted by one if the lengths differ by one.
3. Join: each word gives these three places only. What surrounds a bigram that survived is known as well: the edit
   is either left or right of it, and all else is equal. So the key of a place is the length, the position and the
   word without one segment of its left or right part; a segment has two letters (an eighth of the part, if that's more). Words
   that share a key differ within the segment, so no key is frequent, however frequent its bigram is. A word
   meets others as the shorter or equal one, and once more as the longer one.
4. Verify: sorted runs of a key are compared letter by letter, and a pair is told only at its first common
   place, so none is told twice.

The word's form is its most frequent near word, if that is frequent enough; roots follow from forms by pointer
doubling, the number of steps being bounded by the largest count (each form is ``ratio`` times as frequent as its word).

Cases: a null or empty text has no words; a null identifier counts as empty text; repeated rows count each; equal counts
give the form that sorts first by code points; very long words have longer segments, and are compared whole; an empty table
gives an empty table. Only the columns named are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import give_back, materialize, remove

MIN_LENGTH, MIN_COUNT = 7, 2
#: How much more frequent a form is than its word.
RATIO = 10
#: The typing errors that are put in: one run in ``ERROR_EVERY`` loses a letter.
ERROR_EVERY = 31
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Places of a word that are joined: two bigrams that one edit destroys, and one.
PLACES = 3
#: Letters of a segment at least; segments of a part at most.
SEGMENT, SEGMENTS = 2, 8
#: Bytes of letters compared at once.
AT_ONCE = 1 << 24
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_LATIN = "ISO-8859-1"


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """``doc`` (the identifier as text) and ``run``: the maximal runs of at least ``min_length`` letters, A-Z lower-cased."""
    found = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))).alias("run"))
    # Only words that lower-casing changes are worth the slower, narrower change.
    return found.withColumn("run", F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(F.translate("run", UPPER, LOWER)))


def mistyped(doc: Column, run: Column, every: int = ERROR_EVERY) -> Column:
    """The run, without one letter where the checksum of document and run is divisible by ``every``."""
    check = F.crc32(F.concat(doc, F.lit(":"), run).cast("binary"))
    lost = F.pmod(check, F.length(run).cast("bigint")).cast("int")
    return F.when(check % every == 0, F.concat(F.substr(run, F.lit(1), lost), F.substr(run, lost + 2))).otherwise(run)


def word_counts(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``word`` and ``n`` of a table of occurrences ``word``."""
    counts = words.filter(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= min_count)


def bigram_ranks(words: DataFrame) -> np.ndarray:
    """The rank of each bigram of bytes, the rarest first, ties by the bigram; at most 256² come to the driver."""
    grams = words.select(F.encode("word", _LATIN).alias("b")).mapInArrow(_gram_counts, "gram int, n bigint")
    counts = grams.groupBy("gram").agg(F.sum("n").alias("n")).collect()
    rank = np.full(1 << 16, 1 << 16, np.int64)
    for place, r in enumerate(sorted(counts, key=lambda r: (r.n, r.gram))):
        rank[r.gram] = place
    return rank


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        letters, starts = flat(batch.column(0))
        grams = letters[:-1].astype(np.int64) * 256 + letters[1:]
        inside = np.ones(len(letters), bool)
        inside[starts[1:] - 1] = False  # a word's last letter opens no bigram
        total += np.bincount(grams[inside[:-1]], minlength=1 << 16)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["gram", "n"])


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, and where each value starts (and the last ends)."""
    column = column.cast(pa.large_binary())
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    letters = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return letters[starts[0] : starts[-1]], starts - starts[0]


def parts(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Width and number of the segments of parts of ``m`` letters; an empty part is one empty segment."""
    width = np.maximum(SEGMENT, -(-m // SEGMENTS))
    return width, np.maximum(1, -(-m // width))


def rare_places(letters: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The three rarest places of each row (words of one length), rarest first, ties from the left."""
    grams = letters[:, :-1].astype(np.int64) * 256 + letters[:, 1:]
    order = (rank[grams] << 32) + np.arange(grams.shape[1])
    first = np.sort(np.partition(order, PLACES - 1, 1)[:, :PLACES], 1)
    return first & 0xFFFFFFFF


def word_keys(letters: np.ndarray, rank: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int, int, np.ndarray]]:
    """Keys of words of one length: size, rows, keys, which place, side, segment, places.

    ``size`` is the length of the shorter word of a pair; positions count in it.
    """
    n, length = letters.shape
    places = rare_places(letters, rank)
    head = np.zeros((n, length + 1), np.uint64)
    for i in range(length):
        head[:, i + 1] = head[:, i] * _BASE + letters[:, i] + np.uint64(1)
    power = np.ones(length + 1, np.uint64)
    np.multiply.accumulate(np.full(length, _BASE), out=power[1:])
    rows = np.repeat(np.arange(n), PLACES)
    which = np.tile(np.arange(PLACES), n)
    for longer in (0, 1):
        size = length - longer
        for side in (0, 1):
            at = places.ravel() - (longer if side == 0 else 0)
            m = at if side == 0 else size - at - 2
            width, count = parts(np.maximum(m, 0))
            for segment in range(int(count.max())):
                fits = (m >= 0) & (segment < count)
                p, w, of = at[fits], width[fits], rows[fits]
                first = (0 if side == 0 else p + 2) + segment * w
                last = np.minimum(first + w, p if side == 0 else size)
                tail = head[of, length] - head[of, last + longer] * power[length - last - longer]
                key = (head[of, first] * _MIX) ^ (tail + (p * 4 + side).astype(np.uint64) * _MIX) ^ (first.astype(np.uint64) << np.uint64(40))
                key = (key ^ (key >> np.uint64(31))) * _MIX
                yield size, of, key.view(np.int64), which[fits], side, segment, places[of]


def entries(words: DataFrame, rank: np.ndarray) -> DataFrame:
    """A row for each key of each word: ``size``, ``key``, ``longer``, what the pair's check needs, ``word`` (bytes) and ``n``."""
    shared = words.sparkSession.sparkContext.broadcast(rank)  # 65,536 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters, starts = flat(batch.column(0))
            lengths = np.diff(starts)
            for length in np.unique(lengths):
                mine = np.flatnonzero(lengths == length)
                grid = letters[(starts[mine][:, None] + np.arange(length))]
                for size, of, key, which, side, segment, places in word_keys(grid, shared.value):
                    k = len(of)
                    rows = pa.array(mine[of])
                    columns = [np.full(k, size, np.int32), key, np.full(k, length - size, np.int8), which.astype(np.int8), np.full(k, 2 * segment + side, np.int8), *places.T.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), batch.column(0).take(rows), batch.column(1).take(rows)], names)
            give_back()

    names = ["size", "key", "longer", "which", "segment", "p0", "p1", "p2", "word", "n"]
    bytes_of = words.select(F.encode("word", _LATIN).alias("word"), "n")
    return bytes_of.mapInArrow(run, "size int, key bigint, longer tinyint, which tinyint, segment tinyint, p0 int, p1 int, p2 int, word binary, n bigint")


def edits(x: np.ndarray, y: np.ndarray, longer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the rows are at exactly one edit, and where: the letter replaced, or before which of ``x`` one of ``y`` is put in.

    ``y`` has a letter more where ``longer``; the last column of the others is padding.
    """
    size = x.shape[1] - 1
    unlike = x[:, :size] != y[:, :size]
    where = np.where(unlike.any(1), unlike.argmax(1), size)
    after = np.arange(size) >= where[:, None]
    shifted = ~((x[:, :size] != y[:, 1:]) & after).any(1)
    return np.where(longer, shifted, unlike.sum(1) == 1), where


def first_meeting(where: np.ndarray, longer: np.ndarray, size: int, px: np.ndarray, py: np.ndarray, wx: np.ndarray, wy: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Whether a pair is to be told at this key: the place survives, the edit is in the segment, and no rarer place that both have survives."""
    left = where[:, None] < px + longer[:, None]  # the edit is left of the bigram
    right = where[:, None] >= px + 2
    image = px + (left & longer[:, None])
    common = (left | right) & (image[:, :, None] == py[:, None, :]).any(2)
    mine = np.arange(len(wx))
    first = common.any(1) & (common.argmax(1) == wx)
    met = py[mine, wy] == image[mine, wx]
    p, is_left = px[mine, wx], left[mine, wx]
    m = np.where(is_left, p, size - p - 2)
    width, count = parts(np.maximum(m, 0))
    inside = np.minimum((where - np.where(is_left, 0, p + 2)) // width, count - 1)
    return first & met & (segment == 2 * inside + np.where(is_left, 0, 1))


def _pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Near words among rows sorted by size, key and length, whole keys together."""
    size, key, longer = (rows.column(c).to_numpy() for c in ("size", "key", "longer"))
    which, segment = (rows.column(c).to_numpy() for c in ("which", "segment"))
    places = np.stack([rows.column(c).to_numpy() for c in ("p0", "p1", "p2")], 1)
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (size[1:] != size[:-1])
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(key))[np.cumsum(new) - 1]
    partners = np.where(longer == 0, ends - np.arange(len(key)) - 1, 0)
    word, n = (pa.concat_arrays(rows.column(c).chunks) for c in ("word", "n"))
    blocks = np.flatnonzero(np.append(True, size[1:] != size[:-1])) if len(size) else []
    for begin, end in zip(blocks, [*blocks[1:], len(size)], strict=True):
        c = int(size[begin])
        letters, at = flat(word.slice(begin, end - begin))
        grid = np.zeros((end - begin, c + 1), np.uint8)
        for more in (0, 1):
            mine = np.flatnonzero(longer[begin:end] == more)
            grid[mine, : c + more] = letters[at[mine][:, None] + np.arange(c + more)]
        limit = max(1, AT_ONCE // (c + 1))
        summed = np.cumsum(partners[begin:end])
        start = 0
        while start < end - begin:
            stop = max(start + 1, int(np.searchsorted(summed, (summed[start - 1] if start else 0) + limit, "right")))
            count = partners[begin + start : begin + stop]
            x = np.repeat(np.arange(start, stop), count)
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(count) - count, count)
            start = stop
            if not len(x):
                continue
            more = longer[begin + y] == 1
            near, where = edits(grid[x], grid[y], more)
            x, y, where, more = x[near], y[near], where[near], more[near]
            a, b = begin + x, begin + y
            told = first_meeting(where, more, c, places[a], places[b], which[a], which[b], segment[a])
            a, b = pa.array(a[told]), pa.array(b[told])
            yield pa.RecordBatch.from_arrays([word.take(a), word.take(b), n.take(b)], ["word", "near", "near_n"])
            yield pa.RecordBatch.from_arrays([word.take(b), word.take(a), n.take(a)], ["word", "near", "near_n"])


def near_pairs(words: DataFrame) -> DataFrame:
    """``word``, ``near`` (bytes), ``near_n``: every two words at one edit, once each way."""
    rank = bigram_ranks(words)
    sorted_rows = entries(words, rank).repartition("size", "key").sortWithinPartitions("size", "key", "longer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if waiting:
                # The rows before the last key are complete once another key is seen.
                last = [batch.column(c)[batch.num_rows - 1].as_py() for c in (0, 1)]
                same = (batch.column(0).to_numpy() == last[0]) & (batch.column(1).to_numpy() == last[1])
                cut = batch.num_rows - int(same.sum())
                if cut == 0 and [waiting[-1].column(c)[waiting[-1].num_rows - 1].as_py() for c in (0, 1)] == last:
                    waiting.append(batch)
                    continue
                yield from _pairs(pa.Table.from_batches([*waiting, batch.slice(0, cut)]))
                waiting = [batch.slice(cut)]
                give_back()
            else:
                waiting = [batch]
        if waiting:
            yield from _pairs(pa.Table.from_batches(waiting))

    return sorted_rows.mapInArrow(run, "word binary, near binary, near_n bigint")


def forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form`` and ``form_n`` of every word of a table ``word``, ``n``."""
    best = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    best = best.select(F.decode("word", _LATIN).alias("word"), "n_near", (-F.col("best.less")).alias("best_n"), F.decode("best.near", _LATIN).alias("best"))
    enough = F.col("best_n") >= ratio * F.col("n")
    joined = words.join(best, "word", "left")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(enough, F.col("best")).alias("form"), F.when(enough, F.col("best_n")).alias("form_n"))


def roots(formed: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``formed`` with ``root``: where its forms lead.

    Each form's count is ``ratio`` times that of its word, so chains are short; each round doubles what is followed.
    """
    largest = formed.agg(F.max("form_n")).first()[0]
    steps = math.ceil(math.log(max(largest or 1, 2), ratio)) + 1
    links = formed.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    for step in range(max(1, math.ceil(math.log2(steps)))):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        before, links = links, materialize(links.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
        if step:
            remove(before.sparkSession, before)
    return formed.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int | None = None, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of the words of all texts.

    With ``every``, one run in so many loses a letter first (``mistyped``).
    """
    found = runs(docs, id_col, text_col, min_length)
    word = F.col("run") if every is None else mistyped(F.col("doc"), F.col("run"), every)
    words = materialize(word_counts(found.select(word.alias("word")), min_length, min_count), "spelling-words")
    formed = materialize(forms(words, ratio), "spelling-forms")
    return roots(formed, ratio).select("word", "form", "root", "n", "n_near", "form_n")
