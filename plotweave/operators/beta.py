"""Beta diversity: dissimilarity between windows and their place in an ordination."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotweave.operators.alpha import PCELIM, shares

#: Training plots of an ordination at most; their matrix is held on the driver.
MAX_TRAINING = 5_000
#: Training plots that are broadcast at most, where their matrix isn't held (``ordination.spread_coordinates``).
MAX_SHARED = 200_000
#: Distances of windows to training plots that a task holds at a time.
CELLS = 1 << 19


def species_shares(counts: DataFrame, keys: Sequence[str], pcelim: float = PCELIM) -> DataFrame:
    """``keys``, ``cid``, ``p``: the sparse species distribution of each window."""
    return shares(counts, keys, pcelim).select(*keys, "cid", "p")


def dense(sparse: DataFrame, keys: Sequence[str], n_species: int) -> DataFrame:
    """``keys`` and ``ssd``, an array of the shares of species 1 to ``n_species``."""
    listed = sparse.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("cid", "p"))).alias("_m"))
    ids = F.sequence(F.lit(1), F.lit(n_species))
    return listed.select(*keys, F.transform(ids, lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0))).alias("ssd"))


def bray_curtis_pairs(sparse: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """``by``, ``a``, ``b`` (``a`` before ``b``), ``bc`` for all pairs of windows.

    Shares of both sides sum to 1, so only species that both have count:
    the dissimilarity is 1 less the sum of the smaller shares. The join is on the species; windows
    without a common one follow from the list of windows. The result has all pairs, so
    it is for plots and training windows, ``MAX_TRAINING`` at most; with more it raises.
    """
    names = list(by)
    if sparse.select(key).distinct().limit(MAX_TRAINING + 1).count() > MAX_TRAINING:
        raise ValueError(f"more than {MAX_TRAINING} plots to compare")
    totals = sparse.groupBy(*names, key).agg(F.sum("p").alias("t"))
    left, right = (sparse.select(*names, F.col(key).alias(x), "cid", F.col("p").alias(f"p{x}")) for x in "ab")
    shared = left.join(right, [*names, "cid"]).filter("a < b").groupBy(*names, "a", "b").agg(F.sum(F.least("pa", "pb")).alias("m"))
    ta, tb = (totals.select(*names, F.col(key).alias(x), F.col("t").alias(f"t{x}")) for x in "ab")
    pairs = (ta.join(tb, names) if names else ta.crossJoin(tb)).filter("a < b")
    both = pairs.join(shared, [*names, "a", "b"], "left")
    return both.select(*names, "a", "b", (F.lit(1.0) - F.lit(2.0) * F.coalesce("m", F.lit(0.0)) / (F.col("ta") + F.col("tb"))).alias("bc"))


def mean_over_iterations(pairs: DataFrame) -> DataFrame:
    """``a``, ``b``, ``bc``, averaged over ``iter``."""
    return pairs.groupBy("a", "b").agg(F.avg("bc").alias("bc"))


def bray_curtis_to(windows: DataFrame, training: DataFrame, key: str) -> DataFrame:
    """``key``, ``train_id``, ``bc`` of each window to each training plot, by a join on the species."""
    shared = windows.join(training.withColumnRenamed("p", "q"), "cid").groupBy(key, "train_id").agg(F.sum(F.least("p", "q")).alias("m"))
    pairs = windows.select(key).distinct().crossJoin(training.select("train_id").distinct())
    return pairs.join(shared, [key, "train_id"], "left").select(key, "train_id", (F.lit(1.0) - F.coalesce("m", F.lit(0.0))).alias("bc"))


def project_shares(shares: DataFrame, training: DataFrame, coordinates: DataFrame, key: str, axes: Sequence[str], k: int = 3) -> DataFrame:
    """``key`` and ``axes``: places of windows in the ordination of training plots, from sparse shares of both.

    ``shares`` has ``key``, ``cid``, ``p``; ``training`` (``train_id``, ``cid``, ``p``) and ``coordinates`` are bounded
    (``MAX_TRAINING`` plots, checked) and broadcast, so a window meets no row per plot. Species that no
    plot has are one species more.
    """
    names = [r.train_id for r in training.select("train_id").distinct().orderBy("train_id").limit(MAX_TRAINING + 1).collect()]
    if len(names) > MAX_TRAINING:
        raise ValueError(f"more than {MAX_TRAINING} training plots")
    rows = training.select("train_id", "cid", "p").collect()
    species = {c: i for i, c in enumerate(sorted({r.cid for r in rows}))}
    at = {n: i for i, n in enumerate(names)}
    plots, places = np.zeros((len(names), len(species) + 1)), np.zeros((len(names), len(axes)))
    for r in rows:
        plots[at[r.train_id], species[r.cid]] += r.p
    for r in coordinates.filter(F.col("train_id").isin(names)).collect():
        places[at[r.train_id]] = [r[x] for x in axes]
    kind = training.schema["cid"].dataType.simpleString()
    numbers = shares.sparkSession.createDataFrame([(c, i + 1) for c, i in species.items()], f"cid {kind}, _no int")
    known = shares.join(F.broadcast(numbers), "cid", "left").select(key, F.coalesce("_no", F.lit(len(species) + 1)).alias("cid"), "p")
    windows = dense(known.groupBy(key, "cid").agg(F.sum("p").alias("p")), [key], len(species) + 1)
    found = project(windows, plots, places, [key], k)
    return found.select(key, *(F.col("coord")[i].alias(x) for i, x in enumerate(axes)))


def weighted_neighbours(distances: DataFrame, coordinates: DataFrame, key: str, axes: Sequence[str], k: int = 3) -> DataFrame:
    """``key`` and ``axes``: coordinates of the ``k`` nearest training plots, weighted by inverse distance.

    At distance 0 the first of the nearest counts alone; equal distances go by ``train_id``.
    """
    order = Window.partitionBy(key).orderBy("bc", "train_id")
    near = distances.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= k).join(coordinates, "train_id")
    weighted = [F.when(F.min("bc") == 0, F.min_by(x, F.struct("bc", "train_id"))).otherwise(F.try_divide(F.sum(F.try_divide(F.col(x), F.col("bc"))), F.sum(F.try_divide(F.lit(1.0), F.col("bc"))))).alias(x) for x in axes]
    return near.groupBy(key).agg(*weighted)


def project(windows: DataFrame, training: np.ndarray, coordinates: np.ndarray, keys: Sequence[str], k: int = 3, n_iter: int | None = None) -> DataFrame:
    """``keys`` and ``coord``: places of windows in the ordination of a training set.

    ``windows`` has ``ssd``, the dense distributions of all iterations one after another;
    ``training`` is plots by the same, ``coordinates`` plots by axes. Both are bounded
    (``MAX_SHARED``) and broadcast, so windows need no shuffle.
    """
    if len(training) > MAX_SHARED:
        raise ValueError(f"more than {MAX_SHARED} training plots")
    shared = windows.sparkSession.sparkContext.broadcast((training, coordinates))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in windows.select(*keys).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plots, places = shared.value
        for batch in batches:
            own = np.stack(batch["ssd"].to_numpy()) if len(batch) else np.zeros((0, plots.shape[1]))
            out = batch[list(keys)].copy()
            out["coord"] = list(placed(own, plots, places, k, n_iter or 1))
            yield out

    return windows.select(*keys, "ssd").mapInPandas(run, f"{fields}, coord array<double>")


def placed(windows: np.ndarray, training: np.ndarray, places: np.ndarray, k: int, n_iter: int) -> np.ndarray:
    """Places of windows, a few at a time, so that distances and their order stay small whatever a batch and the training set hold."""
    some = max(1, CELLS // max(1, len(training)))
    parts = [nearest_places(bray_curtis_matrix(windows[i : i + some], training, n_iter), places, k) for i in range(0, len(windows), some)]
    return np.concatenate(parts) if parts else np.zeros((0, places.shape[1]))


def bray_curtis_matrix(a: np.ndarray, b: np.ndarray, n_iter: int = 1, block: int = 256) -> np.ndarray:
    """Dissimilarities of the rows of two matrices, averaged over ``n_iter`` parts of the columns."""
    out = np.zeros((len(a), len(b)))
    block = max(1, min(block, 8 * CELLS // max(1, len(b) * (b.shape[1] // n_iter))))
    for part_a, part_b in zip(np.split(a, n_iter, 1), np.split(b, n_iter, 1), strict=True):
        for start in range(0, len(a), block):
            own = part_a[start : start + block, None, :]
            gap, total = np.abs(own - part_b).sum(2), (own + part_b).sum(2)
            out[start : start + block] += np.divide(gap, total, out=np.zeros_like(gap), where=total > 0)
    return out / n_iter


def nearest_places(distance: np.ndarray, places: np.ndarray, k: int = 3) -> np.ndarray:
    """Places by inverse distance among the ``k`` nearest; distances that differ by rounding alone are ties, which go to the first."""
    k, distance = min(k, distance.shape[1]), np.round(distance, 12)
    near, left = np.zeros((len(distance), k), int), distance.copy()
    for j in range(k):
        near[:, j] = left.argmin(1)
        np.put_along_axis(left, near[:, j : j + 1], np.inf, 1)
    d = np.take_along_axis(distance, near, 1)
    exact = d[:, :1] == 0
    w = np.where(exact, np.arange(k)[None, :] == 0, 1 / np.where(d == 0, 1, d))
    return (w[:, :, None] * places[near]).sum(1) / w.sum(1, keepdims=True)
