"""Spectral species: k-means on lots of a sample, and the nearest centroid of every pixel."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.operators.masks import clean, iqr_bounds
from plotweave.operators.transforms import scale
from plotweave.sources.shared import written

N_CLUSTERS, N_ITER, N_START, MAX_STEPS = 50, 10, 10, 50
MAX_CENTROIDS = 10_000
#: Points of a lot that a task fits at most; points that starts of larger lots are made of, about; points of a run that are transferred in a pass, about.
LOT_ROWS, START_ROWS, ACTIVE = 20_000, 4_096, 8_192
#: What a pass says of a run: sums of clusters, and points whose transfer is near.
KINDS = {"k": pa.int32(), "iter": pa.int32(), "start": pa.int32(), "cid": pa.int32(), "n": pa.int64(), "x": pa.list_(pa.float64()), "cost": pa.float64(), "norm": pa.float64(), "active": pa.bool_()}


@dataclass(frozen=True)
class SpeciesModel:
    """``centroids``: iter (from 1), cid (from 1), center, cost. ``bounds``: band, low, high. Both are small tables."""

    centroids: DataFrame
    bounds: DataFrame
    bands: tuple[str, ...]

    def arrays(self) -> list[np.ndarray]:
        """The centroids of each iteration: clusters by bands, at most a few thousand numbers."""
        rows = self.centroids.orderBy("iter", "cid").collect()
        by_iter: dict[int, list] = {}
        for r in rows:
            by_iter.setdefault(r.iter, []).append(r.center)
        return [np.array(by_iter[i], float) for i in sorted(by_iter)]

    def kept(self) -> SpeciesModel:
        """The same model as local rows, so that nothing fits it twice; it has at most a few thousand rows."""
        spark = self.centroids.sparkSession
        own = lambda t: spark.createDataFrame(t.collect(), t.schema)
        return SpeciesModel(own(self.centroids), own(self.bounds), self.bands)

    def save(self, path: str) -> None:
        self.centroids.write.mode("overwrite").parquet(f"{path}/centroids")
        self.bounds.write.mode("overwrite").parquet(f"{path}/bounds")

    @classmethod
    def load(cls, spark, path: str, bands: Sequence[str]) -> SpeciesModel:
        return cls(spark.read.parquet(f"{path}/centroids"), spark.read.parquet(f"{path}/bounds"), tuple(bands))


def nearest(points: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest centre (the first on ties) and the squared distance."""
    d = (centers * centers).sum(1) - 2 * points @ centers.T
    at = d.argmin(1)
    return at, np.maximum(0, d[np.arange(len(points)), at] + (points * points).sum(1))


def spread_start(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` points drawn one after another, in proportion to the squared distance to those drawn (k-means++)."""
    centers = points[[rng.integers(len(points))]]
    while len(centers) < min(k, len(points)):
        d = nearest(points, centers)[1]
        total = d.sum()
        centers = np.vstack([centers, points[rng.choice(len(points), p=d / total) if total > 0 else rng.integers(len(points))]])
    return centers


def lloyd_steps(points: np.ndarray, centers: np.ndarray, steps: int) -> np.ndarray:
    """Means of nearest points, until nothing moves; a cluster without points keeps its centre."""
    for _ in range(steps):
        at = nearest(points, centers)[0]
        counts = np.bincount(at, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, at, points)
        moved = np.where(counts[:, None] > 0, sums / np.maximum(1, counts)[:, None], centers)
        if np.array_equal(moved, centers):
            break
        centers = moved
    return centers


class Transfers:
    """Single transfers between clusters (Hartigan and Wong 1979): a point leaves its cluster of ``n`` for one of ``m`` if that lowers the sum of squares,
    ``m / (m + 1) |x - c'|^2 < n / (n - 1) |x - c|^2``; both means move at once.

    Distances to all centres are kept, and made again only for live clusters, those that changed since the last stage. A
    point of a cluster that isn't live is compared with live ones only.
    """

    def __init__(self, points: np.ndarray, centers: np.ndarray):
        self.points = points
        self.at = nearest(points, centers)[0]
        self.counts = np.bincount(self.at, minlength=len(centers))
        self.centers = centers.copy()
        for c in np.flatnonzero(self.counts):
            self.centers[c] = points[self.at == c].mean(0)
        self.distance = np.empty((len(points), len(centers)))
        self.live = np.ones(len(centers), bool)
        #: Gains below this are rounding.
        self.least = 1e-12 * float((points * points).sum() / max(1, len(points)) + 1e-300)

    def refresh(self) -> None:
        """Distances to the centres that moved."""
        for c in np.flatnonzero(self.live):
            apart = self.points - self.centers[c]
            self.distance[:, c] = np.einsum("ij,ij->i", apart, apart)

    def leaving(self, i: np.ndarray | int) -> np.ndarray:
        """What the cost falls by if the points leave; a cluster's only point stays."""
        n = self.counts[self.at[i]]
        apart = self.points[i] - self.centers[self.at[i]]
        return np.where(n > 1, n / np.maximum(1, n - 1) * (apart * apart).sum(-1), 0.0)

    def move(self, i: int, targets: np.ndarray) -> int:
        """Move a point to the best of the targets, if that pays now; where it was."""
        own = int(self.at[i])
        apart = self.points[i] - self.centers[targets]
        joining = self.counts[targets] / (self.counts[targets] + 1) * (apart * apart).sum(1)
        joining[targets == own] = np.inf
        best = int(joining.argmin())
        to = int(targets[best])
        if self.counts[own] < 2 or not joining[best] < float(self.leaving(i)) - self.least:
            return -1
        x, n, m = self.points[i], self.counts[own], self.counts[to]
        self.centers[own] += (self.centers[own] - x) / (n - 1)
        self.centers[to] += (x - self.centers[to]) / (m + 1)
        self.counts[own] -= 1
        self.counts[to] += 1
        self.at[i] = to
        return own

    def optimal(self) -> int:
        """The optimal-transfer stage: every point against all clusters, or the live ones. How many moved."""
        self.refresh()
        joining = self.distance * (self.counts / (self.counts + 1))
        joining[np.arange(len(self.at)), self.at] = np.inf
        joining[np.ix_(~self.live[self.at], ~self.live)] = np.inf
        hopeful = np.flatnonzero(joining.min(1) < self.leaving(np.arange(len(self.at))) - self.least)
        changed = np.zeros(len(self.counts), bool)
        everywhere = np.arange(len(self.counts))
        moved = 0
        for i in hopeful:
            own = self.move(i, everywhere)
            if own >= 0:
                changed[[own, self.at[i]]] = True
                moved += 1
        self.live = changed
        return moved

    def quick(self, steps: int) -> None:
        """The quick-transfer stage: points swap between their two nearest clusters as long as that pays."""
        self.refresh()
        two = np.argpartition(self.distance, 1, 1)[:, :2] if len(self.counts) > 1 else None
        open_ = self.live.copy()
        for _ in range(steps if two is not None else 0):
            mine = np.flatnonzero(open_[two].any(1))
            other = np.where(two[mine, 0] == self.at[mine], two[mine, 1], two[mine, 0])
            apart = self.points[mine] - self.centers[other]
            joining = self.counts[other] / (self.counts[other] + 1) * (apart * apart).sum(1)
            pays = joining < self.leaving(mine) - self.least
            open_ = np.zeros(len(self.counts), bool)
            for i, to in zip(mine[pays], other[pays], strict=True):
                own = self.move(int(i), np.array([to]))
                if own >= 0:
                    open_[[own, to]] = True
            self.live |= open_
            if not open_.any():
                return


def transfer_steps(points: np.ndarray, centers: np.ndarray, steps: int) -> np.ndarray:
    """Centres that no single transfer improves. Lloyd's steps come first, as they move many points at once; what they leave is transferred."""
    state = Transfers(points, lloyd_steps(points, centers, steps))
    while state.optimal():
        state.quick(steps)
    for c in np.flatnonzero(state.counts):
        state.centers[c] = points[state.at == c].mean(0)  # without the rounding of the moves
    return state.centers


#: How centres move on from a start.
ALGORITHMS = {"hartigan-wong": transfer_steps, "lloyd": lloyd_steps}


def kmeans(points: np.ndarray, k: int, starts: int, steps: int, seed: int, algorithm: str = "hartigan-wong") -> tuple[np.ndarray, float]:
    """The best of several runs from k-means++ starts, and its sum of squares."""
    best, least = points[:k], np.inf
    for start in range(starts):
        centers = ALGORITHMS[algorithm](points, spread_start(points, k, np.random.default_rng([seed, start])), steps)
        cost = float(nearest(points, centers)[1].sum())
        if cost < least:
            best, least = centers, cost
    return best, least


def fit_lots(scaled: DataFrame, bands: Sequence[str], lot: str, clusters: Sequence[int] = (N_CLUSTERS,), starts: int = N_START, steps: int = MAX_STEPS, seed: int = 0, algorithm: str = "hartigan-wong") -> DataFrame:
    """``k``, ``iter``, ``cid``, ``center``, ``cost``: a k-means (``ALGORITHMS``) for each lot and number of clusters.

    Lots of up to ``LOT_ROWS`` points are held by a task each; with a larger one all are fitted by passes over the points (``fit_passes``).
    """
    if algorithm not in ALGORITHMS:
        raise ValueError(f"no algorithm {algorithm}; there are {', '.join(ALGORITHMS)}")
    sizes = {r._iter: r.n for r in scaled.groupBy(F.col(lot).alias("_iter")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a lot
    if max(sizes.values(), default=0) > LOT_ROWS:
        return fit_passes(scaled, bands, lot, sizes, clusters, starts, steps, seed, algorithm)
    each = scaled.select(F.col(lot).alias("_iter"), *bands, F.explode(F.array(*map(F.lit, clusters))).alias("_clusters"))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        k, it = int(group["_clusters"].iloc[0]), int(group["_iter"].iloc[0])
        points = group[list(bands)].to_numpy(float)
        points = points[np.lexsort(points.T[::-1])]
        centers, cost = kmeans(points, k, starts, steps, seed + it, algorithm)
        return pd.DataFrame({"k": k, "iter": it, "cid": np.arange(1, len(centers) + 1), "center": list(centers), "cost": cost})

    return each.groupBy("_clusters", "_iter").applyInPandas(fit, "k int, iter int, cid int, center array<double>, cost double")


def margins(points: np.ndarray, centers: np.ndarray, counts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """What the best transfer of each point from its cluster adds to the sum of squares; below zero it pays."""
    d = np.maximum(0, (points * points).sum(1)[:, None] + (centers * centers).sum(1) - 2 * points @ centers.T)
    rows, n = np.arange(len(points)), counts[at]
    leaving = np.where(n > 1, n / np.maximum(1, n - 1) * d[rows, at], 0.0)
    joining = d * (counts / (counts + 1))
    joining[rows, at] = np.inf
    return joining.min(1) - leaving


def settle(points: np.ndarray, at: np.ndarray, counts: np.ndarray, sums: np.ndarray, empty: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Means and counts of clusters after transfers of some points (of clusters ``at``) until none pays, the others staying, and how many there were; a cluster without points is at ``empty``."""
    state = Transfers.__new__(Transfers)
    state.points, state.at, state.counts = points, at.copy(), counts.copy()
    state.centers = np.where(counts[:, None] > 0, sums / np.maximum(1, counts)[:, None], empty)
    state.distance, state.live, state.least = np.empty((len(points), len(counts))), np.ones(len(counts), bool), least
    total = 0
    while len(points) and (moved := state.optimal()):
        total += moved
        state.quick(MAX_STEPS)
    sums = sums.copy()
    np.subtract.at(sums, at, points)
    np.add.at(sums, state.at, points)
    return np.where(state.counts[:, None] > 0, sums / np.maximum(1, state.counts)[:, None], state.centers), state.counts, total


def fit_passes(scaled: DataFrame, bands: Sequence[str], lot: str, sizes: dict[int, int], clusters: Sequence[int], starts: int, steps: int, seed: int, algorithm: str) -> DataFrame:
    """``fit_lots`` over lots of any size: every point counts in every pass, and no task holds a lot.

    Starts come from a k-means of some ``START_ROWS`` points of a lot. A pass assigns all points to the nearest centres, adds up their clusters, and lists the
    ``ACTIVE`` points whose transfer costs least. Those are transferred in a task for each run until none pays, the others counting by their clusters' sums; the means
    that result are the centres of the next pass. The sum of squares falls from pass to pass. A run ends where a pass gives back the centres that it was given
    and no point's transfer pays, be it listed or not. All lots, numbers and starts go on side by side.
    """
    spark, d = scaled.sparkSession, len(bands)
    points = written(scaled.select(F.col(lot).alias("_iter"), F.array(*(F.col(b).cast("double") for b in bands)).alias("x")), "lots")
    share = F.create_map(*(F.lit(v) for it, n in sizes.items() for v in (it, max(1, n // START_ROWS))))
    some = points.filter(F.pmod(F.xxhash64("x", F.lit(seed)), share[F.col("_iter")]) == 0)
    some = some.withColumn("_k", F.explode(F.array(*map(F.lit, clusters)))).withColumn("_start", F.explode(F.sequence(F.lit(0), F.lit(starts - 1))))

    def begin(group: pd.DataFrame) -> pd.DataFrame:
        k, it, start = (int(group[c].iloc[0]) for c in ("_k", "_iter", "_start"))
        own = np.stack(group["x"].to_numpy()).astype(float)
        own = own[np.lexsort(own.T[::-1])]
        centers = ALGORITHMS[algorithm](own, spread_start(own, k, np.random.default_rng([seed + it, start])), steps)
        return pd.DataFrame({"k": k, "iter": it, "start": start, "cid": np.arange(len(centers)), "center": list(centers)})

    runs: dict[tuple[int, int, int], list] = {}
    begun = some.groupBy("_k", "_iter", "_start").applyInPandas(begin, "k int, iter int, start int, cid int, center array<double>")
    for r in begun.orderBy("k", "iter", "start", "cid").collect():  # centres only
        runs.setdefault((r.k, r.iter, r.start), []).append(r.center)
    open_ = {run: (np.array(c, float), np.full(len(c), 1 << 40)) for run, c in runs.items()}
    done: dict[tuple[int, int, int], tuple[np.ndarray, float]] = {}
    listed = max(16, ACTIVE // max(1, points.rdd.getNumPartitions())) if algorithm != "lloyd" else 0
    step = 0
    while open_:
        shared = spark.sparkContext.broadcast(dict(open_))

        def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state, near = shared.value, {}
            totals = {run: [np.zeros(len(c), np.int64), np.zeros(c.shape), 0.0, 0.0] for run, (c, _) in state.items()}
            for batch in batches:
                its, x = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(-1, d)
                for it in np.unique(its):
                    own = x[its == it]
                    for run in (r for r in state if r[1] == it):
                        (centers, counts), total = state[run], totals[run]
                        at, gap = nearest(own, centers)
                        total[0] += np.bincount(at, minlength=len(centers))
                        np.add.at(total[1], at, own)
                        total[2] += float(gap.sum())
                        total[3] += float((own * own).sum())
                        if listed and len(centers) > 1:
                            margin = margins(own, centers, counts, at)
                            held = near.get(run, (np.zeros((0, d)), np.zeros(0, int), np.zeros(0)))
                            held = [np.concatenate(v) for v in zip(held, (own, at, margin), strict=True)]
                            first = np.argpartition(held[2], listed)[:listed] if len(held[2]) > listed else slice(None)
                            near[run] = tuple(v[first] for v in held)
            rows = [(*run, c, int(n), s.tolist(), t[2] if c == 0 else 0.0, t[3] if c == 0 else 0.0) for run, t in totals.items() for c, (n, s) in enumerate(zip(t[0], t[1], strict=True))]
            rows += [(*run, int(c), 0, p.tolist(), 0.0, 0.0) for run, (own, at, _) in near.items() for p, c in zip(own, at, strict=True)]
            marks = [False] * sum(len(t[0]) for t in totals.values())
            marks += [True] * (len(rows) - len(marks))
            columns = [*zip(*rows, strict=True), marks] if rows else [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(columns, KINDS.values(), strict=True)], list(KINDS))

        def moved(group: pd.DataFrame) -> pd.DataFrame:
            run = tuple(int(group[c].iloc[0]) for c in ("k", "iter", "start"))
            before, _ = shared.value[run]
            sums_, active = group[~group["active"]], group[group["active"]]
            counts, sums = np.zeros(len(before), np.int64), np.zeros(before.shape)
            order = np.lexsort(np.stack(sums_["x"].to_numpy()).T[::-1])
            np.add.at(counts, sums_["cid"].to_numpy()[order], sums_["n"].to_numpy()[order])
            np.add.at(sums, sums_["cid"].to_numpy()[order], np.stack(sums_["x"].to_numpy())[order])
            means = np.where(counts[:, None] > 0, sums / np.maximum(1, counts)[:, None], before)
            least = 1e-12 * float(sums_["norm"].sum() / max(1, counts.sum()) + 1e-300)
            same, total, after, sizes_ = bool(np.abs(means - before).max() <= 1e-11 * (1 + np.abs(before).max())), 0, means, counts
            if len(active):
                own = np.stack(active["x"].to_numpy()).astype(float)
                after, sizes_, total = settle(own, active["cid"].to_numpy(), counts, sums, before, least)
            held = same and not total
            return pd.DataFrame({"k": run[0], "iter": run[1], "start": run[2], "cid": np.arange(len(before)), "center": list(means if held else after), "n": sizes_, "cost": float(sums_["cost"].sum()), "same": held})

        passed = points.mapInArrow(assigned, ", ".join(f"{c} {t}" for c, t in zip(KINDS, ("int", "int", "int", "int", "bigint", "array<double>", "double", "double", "boolean"), strict=True)))
        rows = passed.groupBy("k", "iter", "start").applyInPandas(moved, "k int, iter int, start int, cid int, center array<double>, n bigint, cost double, same boolean").orderBy("k", "iter", "start", "cid").collect()  # centres only
        step += 1
        after: dict[tuple[int, int, int], list] = {}
        for r in rows:
            after.setdefault((r.k, r.iter, r.start), []).append(r)
        for run, own in after.items():
            centers, counts = np.array([r.center for r in own], float), np.array([r.n for r in own])
            # Margins are by the counts that the centres were made of, so a run is held against them once more before it ends.
            if own[0].same and (not listed or np.array_equal(counts, open_[run][1])) or (not listed and step >= steps):
                done[run] = (centers, own[0].cost)
                del open_[run]
            else:
                open_[run] = (centers, counts)
        shared.unpersist()
    best: dict[tuple[int, int], tuple[np.ndarray, float]] = {}
    for (k, it, _), (centers, cost) in sorted(done.items(), key=lambda x: x[0]):
        if (k, it) not in best or cost < best[k, it][1]:
            best[k, it] = (centers, cost)
    found = [(k, it, c + 1, x.tolist(), cost) for (k, it), (centers, cost) in best.items() for c, x in enumerate(centers)]
    return spark.createDataFrame(found, "k int, iter int, cid int, center array<double>, cost double")


def lot(key: str, lots: int, seed: int = 0) -> Column:
    """Which of ``lots`` lots (from 1) a pixel is in, by a hash of its key, so lots are even but for chance and nothing is sorted."""
    return (F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(lots)) + 1).cast("int")


def fit_species(sample: DataFrame, bands: Sequence[str], key: str, n_iter: int = N_ITER, n_clusters: int = N_CLUSTERS, weight: float = 3.0, starts: int = N_START, steps: int = MAX_STEPS, seed: int = 0, algorithm: str = "hartigan-wong") -> SpeciesModel:
    """Bounds, scaling and one k-means on each of ``n_iter`` lots of a bounded sample."""
    usable = clean(sample, bands)
    bounds = iqr_bounds(usable, bands, weight)
    bounds = sample.sparkSession.createDataFrame(bounds.collect(), bounds.schema)  # a row a band; the model's users need them too
    lots = scale(usable, bounds, bands).withColumn("_lot", lot(key, n_iter, seed))
    return SpeciesModel(fit_lots(lots, bands, "_lot", (n_clusters,), starts, steps, seed, algorithm).drop("k"), bounds, tuple(bands))


def explore_clusters(sample: DataFrame, bands: Sequence[str], key: str, candidates: Sequence[int], n_iter: int = N_ITER, weight: float = 3.0, starts: int = N_START, seed: int = 0, algorithm: str = "hartigan-wong") -> DataFrame:
    """``k``, ``n_iter``, ``cost_mean``, ``cost_sd`` of each candidate number of clusters."""
    usable = clean(sample, bands)
    lots = scale(usable, iqr_bounds(usable, bands, weight), bands).withColumn("_lot", lot(key, n_iter, seed))
    fits = fit_lots(lots, bands, "_lot", candidates, starts, seed=seed, algorithm=algorithm).select("k", "iter", "cost").distinct()
    return fits.groupBy("k").agg(F.count(F.lit(1)).alias("n_iter"), F.avg("cost").alias("cost_mean"), F.stddev_samp("cost").alias("cost_sd"))


def assign(pixels: DataFrame, centers: Sequence[np.ndarray], features: str | Sequence[str], keep: Sequence[str], scaling: Sequence[tuple[float, float]] | None = None) -> DataFrame:
    """``keep`` and ``species``, an array with the nearest centroid (from 1) of each iteration.

    Centroids are a fixed small table and broadcast; pixels stay where they are. ``features``
    is an array column or a list of bands.
    """
    shared = pixels.sparkSession.sparkContext.broadcast((list(centers), None if scaling is None else np.array(scaling, float)))
    column = F.col(features) if isinstance(features, str) else F.array(*(F.col(b).cast("double") for b in features))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pixels.select(*keep).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets, bounds = shared.value
        for batch in batches:
            points = np.stack(batch["_x"].to_numpy()).astype(float) if len(batch) else np.zeros((0, sets[0].shape[1]))
            if bounds is not None:
                points = (points - bounds[:, 0]) / (bounds[:, 1] - bounds[:, 0])
            found = np.stack([nearest(points, c)[0] + 1 for c in sets], 1)
            out = batch[list(keep)].copy()
            out["species"] = list(found.astype(np.int32))
            yield out

    return pixels.select(*keep, column.alias("_x")).mapInPandas(run, f"{fields}, species array<int>")


def assign_model(pixels: DataFrame, model: SpeciesModel, keep: Sequence[str]) -> DataFrame:
    """``assign`` with a fitted model, on pixels with finite bands."""
    bounds = {r.band: (r.low, r.high) for r in model.bounds.collect()}
    return assign(clean(pixels, model.bands), model.arrays(), model.bands, keep, [bounds[b] for b in model.bands])


def several_counts(pixels: DataFrame, models: Sequence[SpeciesModel], keys: Sequence[str]) -> DataFrame:
    """``candidate`` (from 0), ``keys``, ``iter`` (from 1), ``cid``, ``n``: how many pixels of each group each of several models, by bands of its own, gives to a species, in one pass.

    A pixel counts for the models whose bands it has.
    """
    every = sorted({b for m in models for b in m.bands})
    fitted = []
    for m in models:
        bounds = {r.band: (r.low, r.high) for r in m.bounds.collect()}  # a row a band
        fitted.append(([every.index(b) for b in m.bands], m.arrays(), np.array([bounds[b] for b in m.bands], float)))
    shared = pixels.sparkSession.sparkContext.broadcast(fitted)
    places = np.array([(i, it + 1) for i, (_, sets, _) in enumerate(fitted) for it in range(len(sets))], np.int32).reshape(-1, 2)
    width = 1 + max((len(c) for _, sets, _ in fitted for c in sets), default=0)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pixels.select(*keys).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            points, found = batch[every].to_numpy(float), []
            for at, sets, bounds in shared.value:
                own = points[:, at]
                good = np.isfinite(own).all(1)
                own = (np.where(good[:, None], own, 0.0) - bounds[:, 0]) / (bounds[:, 1] - bounds[:, 0])
                found += [np.where(good, nearest(own, c)[0] + 1, 0) for c in sets]
            # Counted within the batch, so that few rows leave it; group, place and species are one number.
            group = batch.groupby(list(keys), dropna=False, sort=False).ngroup().to_numpy()
            first = np.unique(group, return_index=True)[1]
            codes = [(group * len(places) + j) * width + cid for j, cid in enumerate(found)]
            codes, n = np.unique(np.concatenate([c[cid > 0] for c, cid in zip(codes, found, strict=True)]), return_counts=True)
            own, place, cid = codes // (width * len(places)), codes // width % len(places), codes % width
            out = batch[list(keys)].iloc[first[own]].reset_index(drop=True)
            yield out.assign(candidate=places[place, 0], iter=places[place, 1], cid=cid.astype(np.int32), n=n)

    chosen = pixels.select(*keys, *(F.col(b).cast("double").alias(b) for b in every if b not in keys))
    counted = chosen.mapInPandas(run, f"{fields}, candidate int, iter int, cid int, n bigint")
    return counted.groupBy("candidate", *keys, "iter", "cid").agg(F.sum("n").alias("n"))


def assign_native(pixels: DataFrame, centroids: DataFrame, features: str, key: str) -> DataFrame:
    """``key``, ``iter``, ``cid`` with built-in functions: each pixel looks through an iteration's centroids, which are an array.

    ``centroids`` is a model, ``MAX_CENTROIDS`` rows at most; with more it raises. Pixels stay where they are.
    """
    if centroids.limit(MAX_CENTROIDS + 1).count() > MAX_CENTROIDS:
        raise ValueError(f"more than {MAX_CENTROIDS} centroids")
    sets = centroids.groupBy("iter").agg(F.collect_list(F.struct("cid", "center")).alias("own"))
    gap = lambda c: F.aggregate(F.zip_with(F.col(features), c["center"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    best = F.array_min(F.transform("own", lambda c: F.struct(gap(c).alias("d"), c["cid"].alias("cid"))))
    return pixels.select(key, features).crossJoin(F.broadcast(sets)).select(key, "iter", best["cid"].alias("cid"))  # a row an iteration


def transfer_check(points: DataFrame, centroids: DataFrame, features: str, key: str, digits: int = 9) -> DataFrame:
    """``key``, ``clusters`` (of the point's lot), ``improvable``: whether the point's transfer to another cluster lowers the sum of squares, ``centred``: whether its centre is the mean of its cluster.

    ``points`` has ``key``, the features and ``iter``, its lot; it belongs to the nearest centroid of that lot. Differences below
    ``10^-digits`` of a distance don't count.
    """
    near = assign_native(points, centroids, features, key).join(points.select(key, "iter", features), [key, "iter"])
    means = near.select("iter", "cid", F.posexplode(features).alias("at", "x")).groupBy("iter", "cid", "at").agg(F.avg("x").alias("mean"), F.count(F.lit(1)).alias("n"))
    means = means.groupBy("iter", "cid").agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("at", "mean"))), lambda x: x["mean"]).alias("mean"))
    # A row a cluster, as many as the model has.
    known = centroids.select("iter", "cid", "center").join(F.broadcast(means), ["iter", "cid"], "left")
    gap = F.aggregate(F.zip_with("center", "mean", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: F.greatest(s, x))
    sets = known.withColumn("centred", F.coalesce(gap <= 10.0**-digits, F.lit(False))).groupBy("iter").agg(F.collect_list(F.struct("cid", "center", F.coalesce("n", F.lit(0)).alias("n"), "centred")).alias("own"))
    away = lambda c: F.aggregate(F.zip_with(F.col(features), c["center"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    judged = near.join(F.broadcast(sets), "iter")
    mine = F.filter("own", lambda c: c["cid"] == F.col("cid"))[0]
    leaving = F.when(mine["n"] > 1, mine["n"] / (mine["n"] - 1) * away(mine)).otherwise(0.0)
    joining = F.array_min(F.transform(F.filter("own", lambda c: c["cid"] != F.col("cid")), lambda c: c["n"] / (c["n"] + 1) * away(c)))
    return judged.select(key, F.size("own").cast("bigint").alias("clusters"), F.coalesce(joining < leaving * (1 - 10.0**-digits), F.lit(False)).alias("improvable"), mine["centred"].alias("centred"))
