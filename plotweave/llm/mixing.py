"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Targets: a share of all words is dealt to the sources by weight; what a source can't
   take (more than ``MAX_EPOCHS`` times its words) is dealt to the others.
2. Blocks: each source's documents are dealt by a seeded hash into about as many blocks as
   it has ``BLOCK_WORDS``. A source's target is a number of whole passes over its blocks and a
   part of another pass: the first blocks in order, and of the one at the edge those
   documents that fill the rest best.
3. Splitting tree: the block draws are the cards of a deck with one colour a source. The range of
   output shards is halved again and again; how many draws of each source go left is a
   multivariate-hypergeometric variate, seeded by the tree's node. So each shard gets the
   exact quotas of a fair shuffle of all draws, and can work out its own path alone.
4. A source's draws are ranked in permuted order, a shard takes the ranks that its path gives
   it (disjoint from all others'), and shuffles its documents locally.

The texts are read once, for their sizes. Only tables of sources (at most ``MAX_SOURCES``
rows, checked) reach the driver. Ranks and running sums over the blocks of a source are made in
two steps, within ranges of blocks and over the ranges' sums; other windows run over the documents of one shard.
A task walks the part of the tree that is over its shards once.

Cases: a null text has size 0; a null source is a source, the last; a source without words has
target 0; repeated rows are documents each; equal hashes are ordered by identifier; an empty
table gives an empty mix; a very long document is one document, in one block. Only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.llm.common import byte_values, materialize, slices

WEIGHTS, SHARE, MAX_EPOCHS, SEED = (5.0, 2.0, 1.0), 1.5, 2.0, 20
BLOCK_WORDS, DRAWS_PER_SHARD = 1 << 18, 16
MAX_SOURCES = 1 << 16
#: Blocks of a window.
RANGE = 1 << 12


@dataclass(frozen=True)
class Source:
    """A source by its rank, with its words, target and blocks."""

    rank: int
    name: str | None
    size: int
    target: float
    blocks: int

    @property
    def passes(self) -> int:
        return min(int(self.target // self.size), int(MAX_EPOCHS)) if self.size else 0

    @property
    def rest(self) -> int:
        """Words to take in the pass after the whole ones."""
        return max(0, round(self.target) - self.passes * self.size)


def water_fill(sizes: Sequence[float], weights: Sequence[float], share: float = SHARE, most: float = MAX_EPOCHS) -> list[float]:
    """Shares of ``share`` times all sizes by weight, none above ``most`` times its size."""
    targets, open_, rest = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while open_:
        total = sum(weights[i] for i in sorted(open_))
        over = [i for i in sorted(open_) if rest * weights[i] / total > most * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = rest * weights[i] / total
            break
        for i in over:
            targets[i] = most * sizes[i]
            open_.remove(i)
        rest -= sum(targets[i] for i in over)
    return targets


def plan_sources(totals: dict[str | None, int], weights: Sequence[float] = WEIGHTS, share: float = SHARE) -> list[Source]:
    """Sources by code point, a null one last, with repeating weights."""
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    targets = water_fill([totals[n] for n in names], [weights[k % len(weights)] for k in range(len(names))], share)
    return [Source(k, n, totals[n], t, max(1, -(-totals[n] // BLOCK_WORDS))) for k, (n, t) in enumerate(zip(names, targets, strict=True))]


def document_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``row`` (unique), ``doc_id``, ``source``, ``size`` and ``h``, a hash of identifier and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes = [len(t.split()) for t in byte_values(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(sizes, pa.int64())], ["doc_id", "source", "h", "size"])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.withColumn("h", F.xxhash64("doc_id", F.lit(SEED), "text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, source string, h bigint, size bigint").withColumn("row", F.monotonically_increasing_id())


def shard_quotas(quotas: np.ndarray, shards: int, low: int, high: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each shard from ``low`` to before ``high``: the draws of each source that it gets, and how many go to shards before it.

    The number of draws of a node is dealt to its halves in proportion to their shards. Only nodes over the
    wanted shards are visited, each once.
    """
    nodes = [(0, shards, quotas.copy(), np.zeros_like(quotas))]
    while nodes:
        first, count, mine, before = nodes.pop()
        if first >= high or first + count <= low:
            continue
        if count == 1:
            yield first, mine, before
            continue
        left, total = count // 2, int(mine.sum())
        rng = np.random.default_rng([seed, first, count])
        goes = rng.multivariate_hypergeometric(mine, total * left // count, method="marginals") if total else np.zeros_like(mine)
        nodes += [(first + left, count - left, mine - goes, before + goes), (first, left, goes, before)]


def split_quotas(quotas: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The draws of each source that one shard gets, and how many go to shards before it."""
    return next((mine, before) for _, mine, before in shard_quotas(quotas, shards, shard, shard + 1, seed))


def _source_frame(docs: DataFrame, sources: list[Source]) -> DataFrame:
    """Bounded by ``MAX_SOURCES``."""
    rows = [(s.rank, s.name, s.size, s.target, s.blocks, s.passes, s.rest) for s in sources]
    return docs.sparkSession.createDataFrame(rows, "rank int, source string, source_size bigint, target double, blocks bigint, passes int, rest bigint")


def sized(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, list[Source]]:
    """The documents' sizes with their source's rank, size, target and their block; and the sources."""
    sizes = materialize(document_sizes(docs, id_col, text_col, source_col), "sizes")
    totals = sizes.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sources = plan_sources({r.source: r.n for r in totals}, weights, share)
    known = _source_frame(docs, sources)
    rows = sizes.join(known.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    return rows.withColumn("block", F.pmod(F.xxhash64("h", F.lit("block")), "blocks")), sources


def _edge_documents(rows: DataFrame) -> DataFrame:
    """Rows of edge blocks (``rank``, ``row``, ``size``, ``h``, ``left``) that fill what is left best.

    Larger documents go first, each taken if it fits, so the gap is smaller than the
    smallest document left out. A group is one block.
    """

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "h", "row"], ascending=[False, True, True], ignore_index=True)
        room, taken = int(group["left"].iloc[0]) if len(group) else 0, []
        for size in group["size"]:
            taken.append(size <= room)
            room -= size if taken[-1] else 0
        return group.loc[np.array(taken, bool), ["row"]]

    return rows.groupBy("rank").applyInPandas(fill, "row bigint")


class Mix(NamedTuple):
    """``draws``: shard, position, row, doc_id, pass, size. ``rows``: the sized documents, a row each."""

    draws: DataFrame
    rows: DataFrame
    shards: int


def running(rows: DataFrame, key: str, part: Column, order: Sequence[Column | str], value: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over rows of the same ``key`` up to and with this one, in ``order``.

    ``part`` cuts the order into ranges; sums of ranges are added up first, so that no window holds all rows of a key.
    """
    cut = rows.withColumn("_part", part).withColumn("_value", value)
    ranges = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = cut.groupBy(key, "_part").agg(F.sum("_value").alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(ranges), F.lit(0))).drop("_sum")
    within = Window.partitionBy(key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cut.join(before, [key, "_part"]).withColumn(name, F.col("_before") + F.sum("_value").over(within)).drop("_part", "_value", "_before")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    """Draw the mix."""
    rows, sources = sized(docs, weights, share, id_col, text_col, source_col)
    rows = materialize(rows.select("row", "doc_id", "source", "size", "h", "rank", "source_size", "target", "block"), "sized")
    known = _source_frame(docs, sources).select("rank", "passes", "rest", "blocks")
    spark = docs.sparkSession
    sums = materialize(rows.groupBy("rank", "block").agg(F.sum("size").alias("words")).join(known, "rank"), "blocks")
    blocks = running(sums, "rank", F.floor(F.col("block") / RANGE), ["block"], F.col("words"), "upto").withColumn("left", F.col("rest") - F.col("upto") + F.col("words"))
    # The pass after the whole ones takes a block whole, in part or not at all.
    blocks = blocks.select("rank", "block", "passes", "left", F.when(F.col("upto") <= F.col("rest"), 2).when(F.col("left") > 0, 1).otherwise(0).alias("more"))
    draws = blocks.select("rank", "block", "left", "more", "passes", F.explode(F.sequence(F.lit(0), F.col("passes"))).alias("pass")).filter((F.col("pass") < F.col("passes")) | (F.col("more") > 0))
    draws = draws.withColumn("part", (F.col("pass") == F.col("passes")) & (F.col("more") == 1))
    draws = materialize(draws.withColumn("_hash", F.xxhash64("rank", "block", "pass", F.lit(seed))), "draws")
    # Permuted order is that of hashes, of which the first bits make the ranges.
    placed = running(draws, "rank", F.shiftrightunsigned("_hash", 52), [F.shiftrightunsigned("_hash", 1), "_hash", "block", "pass"], F.lit(1), "place")
    draws = materialize(placed.withColumn("place", F.col("place") - 1).drop("_hash"), "placed-draws")
    quotas = {r["rank"]: r.n for r in draws.groupBy("rank").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per source
    counts = np.array([quotas.get(s.rank, 0) for s in sources], np.int64)
    shards = max(1, -(-int(counts.sum()) // DRAWS_PER_SHARD))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()  # neighbours: a part of a range
            for shard, mine, before in shard_quotas(counts, shards, int(own[0]), int(own[-1]) + 1, seed) if len(own) else ():
                ranks = np.flatnonzero(mine)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ranks), shard, np.int64)), pa.array(ranks.astype(np.int32)), pa.array(before[ranks]), pa.array((before + mine)[ranks] - 1)], ["shard", "rank", "low", "high"])

    dealt = spark.range(shards).mapInArrow(deal, "shard bigint, rank int, low bigint, high bigint")
    places = dealt.select("shard", "rank", F.explode(F.sequence("low", "high")).alias("place"))
    drawn = draws.join(places, ["rank", "place"])
    some = rows.filter("size > 0")
    edge = some.join(draws.filter("part").select("rank", "block", "left"), ["rank", "block"]).select("rank", "row", "size", "h", "left")
    partial = _edge_documents(edge).withColumn("fits", F.lit(True))
    taken = some.join(drawn.filter("not part"), ["rank", "block"]).select("shard", "row", "doc_id", "pass", "size", "h")
    whole_edge = some.join(drawn.filter("part"), ["rank", "block"]).join(partial, "row", "left_semi").select("shard", "row", "doc_id", "pass", "size", "h")
    local = Window.partitionBy("shard").orderBy(F.xxhash64("h", "pass", F.lit(seed)), "doc_id", "row", "pass")
    out = taken.unionByName(whole_edge).withColumn("position", F.row_number().over(local) - 1)
    return Mix(out.select("shard", "position", "row", "doc_id", "pass", "size"), rows, shards)


def words_taken(mixed: Mix) -> DataFrame:
    """Each sized row with ``copies``, ``taken``, its words in the mix, and ``places``, its draws as shard:position (``MAX_EPOCHS`` at most)."""
    place = F.struct("shard", "position")
    copies = mixed.draws.groupBy("row").agg(F.count(F.lit(1)).alias("copies"), F.sort_array(F.collect_list(place)).alias("places"))
    return mixed.rows.join(copies, "row", "left").withColumn("copies", F.coalesce("copies", F.lit(0).cast("bigint"))).withColumn("taken", F.col("copies") * F.col("size"))
