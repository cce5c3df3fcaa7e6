"""Alpha diversity of a stream of pixels: counts per window are kept as state, metrics follow from them.

Counts add up, so the streaming aggregation only needs species counts per spatial window (and
event-time window, if asked); the metrics are those of the batch engine on each update.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plotweave.operators.alpha import PCELIM, alpha


def stream_counts(pixels: DataFrame, keys: Sequence[str], species: str, time: str | None = None, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Running ``keys``, ``cid``, ``n``; with ``time``, per tumbling window of it, state beyond ``late`` dropped."""
    if time is None:
        return pixels.groupBy(*keys, F.col(species).alias("cid")).agg(F.count(F.lit(1)).alias("n"))
    timed = pixels.withWatermark(time, late).groupBy(F.window(time, every).alias("_w"), *keys, F.col(species).alias("cid")).agg(F.count(F.lit(1)).alias("n"))
    return timed.select(F.col("_w.start").alias("start"), *keys, "cid", "n")


def run_alpha(counts: DataFrame, keys: Sequence[str], sink: Callable[[DataFrame, int], None], metrics: Sequence[str] = ("richness", "shannon", "simpson"), checkpoint: str | None = None, mode: str = "complete") -> StreamingQuery:
    """Start a query that hands ``sink`` the metrics of each update and its number, over all data there is."""

    def update(batch: DataFrame, number: int) -> None:
        sink(alpha(batch, list(keys), metrics, pcelim=PCELIM), number)

    writer = counts.writeStream.outputMode(mode).foreachBatch(update).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
