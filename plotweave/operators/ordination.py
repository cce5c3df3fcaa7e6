"""Ordination: principal components, maximum noise fraction, principal coordinates.

Covariances come from one aggregation; the eigenproblems are of the size of the bands, or
of a bounded set of training plots, and solved on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.operators.beta import CELLS, MAX_TRAINING, bray_curtis_matrix

#: Residual of spread coordinates, by the largest eigenvalue; vectors beside the axes wanted.
TOLERANCE, WIDER = 1e-11, 5


@dataclass(frozen=True)
class Rotation:
    """Scores are ((x - center) / scale) @ rotation; ``variance`` is each component's."""

    bands: tuple[str, ...]
    center: np.ndarray
    scale: np.ndarray
    rotation: np.ndarray
    variance: np.ndarray


def signed(vectors: np.ndarray) -> np.ndarray:
    """Columns with their largest absolute value positive, the first of equals."""
    at = np.abs(np.round(vectors, 12)).argmax(0)
    return vectors * np.where(vectors[at, np.arange(vectors.shape[1])] < 0, -1, 1)


#: Bands up to which covariances are column expressions.
FEW_BANDS = 16


def array_moments(pixels: DataFrame, column: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, means and sample covariances of an array column of equal lengths; arrays with a missing value are left out.

    Means in one pass, then each task adds up the products of its centred rows as a matrix, and the tasks' sums
    are added by place: half the bands squared numbers a task, and as many on the driver, however many pixels there are.
    """
    whole = pixels.select(F.col(column).cast("array<double>").alias("x")).filter(F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    means = whole.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.count("v").alias("n"), F.avg("v").alias("m")).orderBy("k").collect()  # a row a band
    if not means:
        return 0, np.zeros(0), np.zeros((0, 0))
    center = np.array([r.m for r in means])
    upper = np.triu_indices(len(center))

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(center), len(center)))
        for batch in batches:
            if len(batch):
                rows = np.stack(batch["x"].to_numpy()) - center
                total += rows.T @ rows
        yield pd.DataFrame({"k": np.arange(len(upper[0])), "v": total[upper]})

    sums = whole.mapInPandas(products, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()
    covariance = np.zeros((len(center), len(center)))
    covariance[upper] = [r.v for r in sums]
    covariance = covariance + np.triu(covariance, 1).T
    return means[0].n, center, covariance / max(1, means[0].n - 1)


def moments(pixels: DataFrame, bands: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, means and sample covariances; rows with a missing value are left out. Few bands take one pass of expressions, many ``array_moments``."""
    if len(bands) > FEW_BANDS:
        return array_moments(pixels.select(F.array(*(F.col(b).cast("double") for b in bands)).alias("x")), "x")
    usable = pixels.select(*(F.col(b).cast("double").alias(b) for b in bands)).dropna()
    pairs = [(i, j) for i in range(len(bands)) for j in range(i, len(bands))]
    row = usable.agg(F.count(F.lit(1)), *(F.avg(b) for b in bands), *(F.covar_samp(bands[i], bands[j]) for i, j in pairs)).first()
    covariance = np.zeros((len(bands), len(bands)))
    for (i, j), value in zip(pairs, row[1 + len(bands) :], strict=True):
        covariance[i, j] = covariance[j, i] = value or 0.0
    return row[0], np.array([x or 0.0 for x in row[1 : 1 + len(bands)]]), covariance


def fit_pca(sample: DataFrame, bands: Sequence[str], standardize: bool = False, keep: int | None = None) -> Rotation:
    """Principal components of centred, and with ``standardize`` scaled, bands."""
    return _components(bands, *moments(sample, bands)[1:], standardize, keep)


def _components(bands: Sequence[str], mean: np.ndarray, covariance: np.ndarray, standardize: bool, keep: int | None) -> Rotation:
    sd = np.sqrt(np.diag(covariance)) if standardize else np.ones(len(bands))
    if (sd == 0).any():
        raise ValueError("a constant band can't be scaled")
    values, vectors = np.linalg.eigh(covariance / np.outer(sd, sd))
    order = np.argsort(-values, kind="stable")[:keep]
    return Rotation(tuple(bands), mean, sd, signed(vectors[:, order]), values[order])


def fit_array_pca(sample: DataFrame, column: str, standardize: bool = False, keep: int | None = None, least_sd: float = 0.0) -> tuple[Rotation, list[int]]:
    """Principal components of an array column, without its constant places; and the places (from 0) that are left."""
    _, mean, covariance = array_moments(sample, column)
    left = np.flatnonzero(np.sqrt(np.diag(covariance)) > least_sd).tolist()
    return _components([str(k) for k in left], mean[left], covariance[np.ix_(left, left)], standardize, keep), left


def rotate_array(pixels: DataFrame, model: Rotation, places: Sequence[int], column: str, keep: Sequence[str], select: Sequence[int] | None = None) -> DataFrame:
    """``keep`` and ``pc1`` ... of an array column; an array with a missing value gives nulls."""
    each = pixels.select(*keep, *(F.get(column, F.lit(k)).alias(name) for k, name in zip(places, model.bands, strict=True)))
    return rotate(each, model, keep, select)


def fit_mnf(pixels: DataFrame, noise: DataFrame, bands: Sequence[str]) -> Rotation:
    """Maximum noise fraction: eigenvectors of the inverse noise covariance times the covariance."""
    _, mean, covariance = moments(pixels, bands)
    values, vectors = np.linalg.eig(np.linalg.solve(moments(noise, bands)[2], covariance))
    order = np.argsort(-values.real, kind="stable")
    vectors = vectors.real[:, order]
    return Rotation(tuple(bands), mean, np.ones(len(bands)), signed(vectors / np.linalg.norm(vectors, axis=0)), values.real[order])


def rotate(pixels: DataFrame, model: Rotation, keep: Sequence[str], select: Sequence[int] | None = None) -> DataFrame:
    """``keep`` and ``pc1`` ...: the scores of every pixel (or of the components listed, from 1), as column arithmetic."""
    chosen = select or range(1, model.rotation.shape[1] + 1)
    scaled = [(F.col(b).cast("double") - float(m)) / float(s) for b, m, s in zip(model.bands, model.center, model.scale, strict=True)]
    if len(model.bands) <= 16:
        total = lambda k: sum((x * float(w) for x, w in zip(scaled, model.rotation[:, k - 1], strict=True)), F.lit(0.0))
        return pixels.select(*keep, *(total(k).alias(f"pc{k}") for k in chosen))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pixels.select(*keep).schema)
    shared = pixels.sparkSession.sparkContext.broadcast((model.rotation[:, [k - 1 for k in chosen]], list(keep), list(model.bands), model.center, model.scale))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rotation, names, bands, center, sd = shared.value
        for batch in batches:
            scores = ((batch[bands].to_numpy(float) - center) / sd) @ rotation
            yield pd.concat([batch[names].reset_index(drop=True), pd.DataFrame(scores, columns=[f"pc{k}" for k in chosen])], axis=1)

    return pixels.select(*keep, *model.bands).mapInPandas(run, fields + "".join(f", pc{k} double" for k in chosen))


def principal_coordinates(distance: np.ndarray, axes: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Classical scaling of a distance matrix: coordinates on axes of positive eigenvalue, and all eigenvalues."""
    n = len(distance)
    if n > MAX_TRAINING:
        raise ValueError(f"more than {MAX_TRAINING} plots")
    center = np.eye(n) - 1 / n
    values, vectors = np.linalg.eigh(-0.5 * center @ (distance**2) @ center)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], signed(vectors[:, order])
    use = [k for k in range(min(axes, n)) if values[k] > 1e-12]
    return vectors[:, use] * np.sqrt(values[use]), values


def spread_coordinates(spark: SparkSession, training: np.ndarray, n_iter: int, axes: int = 3) -> np.ndarray:
    """``principal_coordinates`` of more plots than a matrix is held of: dissimilarities are made in blocks of rows by tasks, and made again in each step.

    Block Lanczos steps with full orthogonalisation: the driver holds a few vectors of a number a plot. They go on until the residuals of the
    first ``axes`` are below ``TOLERANCE`` of the largest eigenvalue, or the vectors span everything.
    """
    n, context = len(training), spark.sparkContext
    shared = context.broadcast(training)
    parts = min(max(1, n // 64), 4 * context.defaultParallelism)

    def times(v: np.ndarray) -> np.ndarray:
        """The doubly centred matrix times some vectors."""
        sent = context.broadcast(v - v.mean(0))

        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            plots, vectors = shared.value, sent.value
            for batch in batches:
                at = batch["id"].to_numpy()
                own = [bray_curtis_matrix(plots[i], plots, n_iter) ** 2 @ vectors for i in np.array_split(at, max(1, -(-len(at) * n // CELLS)))]
                yield pd.DataFrame({"id": at, "x": list(np.concatenate(own))})

        found = spark.range(0, n, 1, parts).mapInPandas(rows, "id bigint, x array<double>").orderBy("id").collect()  # as many as plots
        sent.unpersist()
        out = -0.5 * np.array([r.x for r in found], float)
        return out - out.mean(0)

    block = np.random.default_rng(0).standard_normal((n, axes + WIDER))
    block = np.linalg.qr(block - block.mean(0))[0]
    basis, image = block, times(block)
    while True:
        small = basis.T @ image
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values, kind="stable")[:axes]
        ritz = basis @ vectors[:, order]
        left = np.linalg.norm(image @ vectors[:, order] - ritz * values[order], axis=0)
        if left.max() <= TOLERANCE * max(np.abs(values).max(), 1e-300) or basis.shape[1] >= n - 1:
            break
        after = image[:, -block.shape[1] :]
        for _ in range(2):  # once more against rounding
            after = after - basis @ (basis.T @ after)
        block, sizes, _ = np.linalg.svd(after, full_matrices=False)
        block = block[:, sizes > 1e-12 * max(np.abs(values).max(), 1e-300)][:, : n - 1 - basis.shape[1]]
        if not block.shape[1]:
            break
        block = np.linalg.qr(block - basis @ (basis.T @ block))[0]
        basis, image = np.hstack([basis, block]), np.hstack([image, times(block)])
    shared.unpersist()
    use = [k for k in range(len(order)) if values[order[k]] > 1e-12]
    return signed(ritz[:, use]) * np.sqrt(values[order][use])


def distance_matrix(pairs: DataFrame, ids: Sequence) -> np.ndarray:
    """The symmetric matrix of bounded training pairs (``a``, ``b``, ``bc``)."""
    at = {x: i for i, x in enumerate(ids)}
    out = np.zeros((len(ids), len(ids)))
    for r in pairs.select("a", "b", "bc").toLocalIterator():
        out[at[r.a], at[r.b]] = out[at[r.b], at[r.a]] = r.bc
    return out


def ordinate(pairs: DataFrame, windows: DataFrame, key: str, axes: int = 3) -> DataFrame:
    """``key``, ``coord``, ``eigenvalues``: principal coordinates of a bounded set of plots."""
    ids = [r[0] for r in windows.select(key).distinct().orderBy(key).limit(MAX_TRAINING + 1).collect()]
    if len(ids) > MAX_TRAINING:
        raise ValueError(f"more than {MAX_TRAINING} plots")
    coords, values = principal_coordinates(distance_matrix(pairs, ids), axes)
    kind = windows.schema[key].dataType.simpleString()
    rows = [(i, [float(x) for x in c], [float(v) for v in values[:axes]]) for i, c in zip(ids, coords, strict=True)]
    return windows.sparkSession.createDataFrame(rows, f"`{key}` {kind}, coord array<double>, eigenvalues array<double>")
