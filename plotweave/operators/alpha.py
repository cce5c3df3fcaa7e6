"""Alpha diversity from counts of species per window.

All entries, from pixels, plots, classes or abundances, meet in one long frame: the
window's keys, the iteration, the species and ``n``. Pixels are only shuffled as partial
counts; what follows works on a few rows a window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotweave.functions import diversity as fd
from plotweave.operators.windows import enough_pixels

METRICS = ("richness", "shannon", "simpson", "hill", "fisher")
PCELIM = 0.02


def species_counts(pixels: DataFrame, keys: Sequence[str], species: str) -> DataFrame:
    """``keys``, ``cid``, ``n``."""
    return pixels.groupBy(*keys, F.col(species).alias("cid")).agg(F.count(F.lit(1)).alias("n"))


def iteration_counts(pixels: DataFrame, keys: Sequence[str], species: str = "species") -> DataFrame:
    """Counts from an array column with one species an iteration: ``keys``, ``iter`` (from 1), ``cid``, ``n``."""
    long = pixels.select(*keys, F.posexplode(species).alias("iter", "cid"))
    return long.groupBy(*keys, (F.col("iter") + 1).alias("iter"), "cid").agg(F.count(F.lit(1)).alias("n"))


def shares(counts: DataFrame, keys: Sequence[str], pcelim: float = PCELIM) -> DataFrame:
    """``keys``, ``cid``, ``n``, ``p``: shares among the species with at least ``pcelim`` of a window's pixels."""
    window = Window.partitionBy(*keys)
    kept = counts.filter("n > 0").withColumn("_all", F.sum("n").over(window)).filter(F.col("n") >= F.lit(float(pcelim)) * F.col("_all"))
    return kept.withColumn("p", F.col("n") / F.sum("n").over(window)).drop("_all")


def alpha(counts: DataFrame, keys: Sequence[str], metrics: Sequence[str] = ("richness", "shannon", "simpson"), hill_order: float = 1, pcelim: float = PCELIM, min_pixels: float | None = None, strict: bool = True) -> DataFrame:
    """The metrics of each window; windows need more than ``min_pixels`` (as many, if not ``strict``)."""
    if min_pixels is not None:
        counts = enough_pixels(counts, keys, min_pixels, strict)
    p = F.col("p")
    known = {"richness": F.count(p), "shannon": fd.shannon(p), "simpson": fd.simpson(p), "hill": fd.hill(p, hill_order)}
    out = shares(counts, keys, pcelim).groupBy(*keys).agg(*(known[m].alias(m) for m in metrics if m in known), F.count(p).alias("_s"), F.sum("n").alias("_n"))
    if "fisher" in metrics:
        out = out.withColumn("fisher", F.when(F.col("_s") > 1, fd.fisher_alpha("_s", "_n")))
    return out.select(*keys, *metrics)


def over_iterations(per_iteration: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and standard deviation of each metric over the iterations; null if one iteration's is."""
    aggregates = [f(F.col(m)).alias(f"{m}_{name}") for m in metrics for name, f in (("mean", fd.mean_all), ("sd", fd.sd_all))]
    return per_iteration.groupBy(*keys).agg(*aggregates)


def alpha_iterations(counts: DataFrame, keys: Sequence[str], metrics: Sequence[str] = METRICS[:3], hill_order: float = 1, pcelim: float = PCELIM) -> DataFrame:
    """Metrics of counts with an ``iter`` column, averaged over it."""
    return over_iterations(alpha(counts, [*keys, "iter"], metrics, hill_order, pcelim), keys, metrics)


def hill_profile(counts: DataFrame, keys: Sequence[str], orders: Sequence[float], pcelim: float = 0) -> DataFrame:
    """Hill numbers of several orders, as columns ``hill_<q>``."""
    return shares(counts, keys, pcelim).groupBy(*keys).agg(*(fd.hill(F.col("p"), q).alias(f"hill_{q:g}") for q in orders))
