"""Workflows from pixels to diversity: fit on samples, transform everything in one plan."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.operators import alpha as alpha_ops
from plotweave.operators import beta as beta_ops
from plotweave.operators import functional as fd_ops
from plotweave.operators import halo
from plotweave.operators.masks import EXCLUDED_DOMAINS, clean, iqr_bounds, within
from plotweave.operators.ordination import Rotation, fit_array_pca, ordinate, principal_coordinates, rotate_array, spread_coordinates
from plotweave.operators.plots import with_attributes
from plotweave.operators.sampling import sample_all_tiles, sample_fraction, sample_pixels, sample_plots
from plotweave.operators.search import correlation, mantel, paired, paired_ranks, weighted_correlation
from plotweave.operators.species import SpeciesModel, assign_model, fit_species, several_counts
from plotweave.operators.transforms import continuum_removed, scale
from plotweave.operators.windows import enough_pixels, moving_counts, window_id
from plotweave.plans.options import Options, report
from plotweave.sources.shared import written


@dataclass(frozen=True)
class BetaModel:
    """Training plots by species of all iterations, and their principal coordinates; both bounded."""

    training: np.ndarray
    coordinates: np.ndarray
    n_iter: int
    n_clusters: int


@dataclass(frozen=True)
class Model:
    species: SpeciesModel
    beta: BetaModel | None


def stacked_shares(counts: DataFrame, keys: Sequence[str], n_clusters: int, n_iter: int, pcelim: float) -> DataFrame:
    """``keys``, ``ssd``: the dense distributions of all iterations one after another."""
    per_iter = beta_ops.dense(beta_ops.species_shares(counts, [*keys, "iter"], pcelim), [*keys, "iter"], n_clusters)
    listed = per_iter.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("iter", "ssd"))).alias("_l"))
    return listed.filter(F.size("_l") == n_iter).select(*keys, F.flatten(F.transform("_l", lambda x: x["ssd"])).alias("ssd"))


def fit_beta(plots: DataFrame, species: SpeciesModel, options: Options, most: int | None = None) -> BetaModel:
    """Ordinate a bounded sample of plots (``plot_id`` and bands): ``MAX_TRAINING`` of them, or ``most``, whose matrix then isn't held."""
    most = most or beta_ops.MAX_TRAINING
    counts = alpha_ops.iteration_counts(assign_model(plots, species, ["plot_id"]), ["plot_id"])
    rows = stacked_shares(counts, ["plot_id"], options.n_clusters, options.n_iter, options.pcelim).orderBy("plot_id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} training plots")
    training = np.array([r.ssd for r in rows], float)
    if len(training) > beta_ops.MAX_TRAINING:
        return BetaModel(training, spread_coordinates(plots.sparkSession, training, options.n_iter, options.dimensions), options.n_iter, options.n_clusters)
    distance = beta_ops.bray_curtis_matrix(training, training, options.n_iter)
    return BetaModel(training, principal_coordinates(distance, options.dimensions)[0], options.n_iter, options.n_clusters)


def _counted(sample: DataFrame, options: Options) -> DataFrame:
    """The sample for a model's species, written once; says that there is no stored model, and if it is smaller than wanted."""
    report("no_model")
    kept = written(sample, "species-sample")
    if kept.count() < options.alpha_sample:
        report("few_pixels")
    return kept


def fit(pixels: DataFrame, bands: Sequence[str], key: str, options: Options, stored: SpeciesModel | None = None) -> Model:
    """Species from a sample of pixels, unless a model is given, and the ordination of a sample of plots."""
    usable = clean(pixels, bands)
    if stored is None:
        stored = fit_species(_counted(sample_pixels(usable, options.alpha_sample, key), options), bands, key, options.n_iter, options.n_clusters, options.iqr_weight, options.starts, seed=options.seed, algorithm=options.algorithm)
        stored = stored.kept()
    if not options.beta_metrics:
        return Model(stored, None)
    plots = sample_plots(usable, options.beta_sample, key, options.window, options.min_sun)
    return Model(stored, fit_beta(plots, stored, options))


def transform(pixels: DataFrame, model: Model, keys: Sequence[str], options: Options) -> DataFrame:
    """Diversity of every window of ``pixels``, which has ``keys`` and the bands.

    Windows with too few pixels go before species are assigned: Spark wouldn't move that
    filter past the Python stage.
    """
    bands = model.species.bands
    usable = clean(pixels, bands)
    counts = usable.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    good = usable.join(enough_pixels(counts, keys, options.min_sun * options.window**2).select(*keys), list(keys), "left_semi")
    species = alpha_ops.iteration_counts(assign_model(good, model.species, keys), keys)
    out = alpha_ops.alpha_iterations(species, keys, options.alpha_metrics, options.hill_order, options.pcelim)
    if model.beta is not None:
        ssd = stacked_shares(species, keys, model.beta.n_clusters, model.beta.n_iter, options.pcelim)
        out = out.join(beta_ops.project(ssd, model.beta.training, model.beta.coordinates, keys, options.neighbours, model.beta.n_iter), list(keys), "left")
    if options.fd_metrics:
        out = out.join(fd_ops.functional(good, keys, bands, options.fd_metrics), list(keys), "left")
    return out


def window_shares(pixels: DataFrame, species: SpeciesModel, keys: Sequence[str], options: Options) -> DataFrame:
    """``keys``, ``ssd``: the distributions of species over all iterations, of windows of ``pixels``."""
    counts = alpha_ops.iteration_counts(assign_model(clean(pixels, species.bands), species, keys), keys)
    return stacked_shares(counts, keys, options.n_clusters, options.n_iter, options.pcelim)


def transform_moving(pixels: DataFrame, model: Model, options: Options) -> DataFrame:
    """Diversity of the neighbourhood of every pixel: ``r``, ``c`` and what ``transform`` gives for windows.

    Neighbourhoods need more valid pixels than ``min_sun`` of their size.
    """
    bands, keys = model.species.bands, ["r", "c"]
    usable, least = clean(pixels, bands), options.min_sun * options.window**2
    each = assign_model(usable, model.species, keys).select(*keys, F.posexplode("species").alias("iter", "cid")).withColumn("iter", F.col("iter") + 1)
    # Counted once: what follows reads them four times.
    counts = enough_pixels(written(moving_counts(each, "cid", options.window, keep=["iter"]), "moving-counts"), [*keys, "iter"], least)
    out = alpha_ops.alpha_iterations(counts, keys, options.alpha_metrics, options.hill_order, options.pcelim)
    if model.beta is not None:
        ssd = stacked_shares(counts, keys, model.beta.n_clusters, model.beta.n_iter, options.pcelim)
        out = out.join(beta_ops.project(ssd, model.beta.training, model.beta.coordinates, keys, options.neighbours, model.beta.n_iter), keys, "left")
    if options.fd_metrics:
        out = out.join(halo.moving_functional(usable, bands, options.window, options.fd_metrics, least), keys, "left")
    return out


def evaluate(pixels: DataFrame, model: Model, n_cols: int, options: Options, tile: str | None = None) -> DataFrame:
    """Diversity by a model: of fixed windows (of every tile), or with ``moving_window`` around every pixel."""
    if options.moving_window:
        if tile:
            raise ValueError("moving windows don't stop at tiles")
        return transform_moving(pixels, model, options)
    windowed = pixels.withColumn("win_id", window_id(F.col("r"), F.col("c"), options.window, n_cols))
    return transform(windowed, model, [tile, "win_id"] if tile else ["win_id"], options)


def diversity(pixels: DataFrame, bands: Sequence[str], key: str, n_cols: int, options: Options, tile: str | None = None) -> DataFrame:
    """The whole workflow on a grid: fit, then every window (of every tile), or the neighbourhood of every pixel."""
    return evaluate(pixels, fit(pixels, bands, key, options), n_cols, options, tile)


def tile_masks(pixels: DataFrame, bands: Sequence[str], tile: str, key: str, options: Options, n_stats: int | None = None, order: Column | None = None) -> DataFrame:
    """Pixels of all tiles within the bounds of all, or of a sample of about ``n_stats`` that takes the same share of each."""
    usable = clean(pixels, bands)
    part = usable
    if n_stats is not None:
        # Quartiles read the sample three times, and its ranks are those of all pixels.
        part = written(sample_fraction(usable, tile, n_stats / max(1, usable.count()), key, order).select(*bands), "mask-sample")
    return within(usable, iqr_bounds(part, bands, options.iqr_weight), bands).filter("mask = 1").drop("mask")


def fit_tiles(pixels: DataFrame, bands: Sequence[str], tile: str, key: str, options: Options, stored: SpeciesModel | None = None) -> Model:
    """As ``fit``, from samples that take of every tile in proportion to its pixels."""
    sample, plots = sample_all_tiles(pixels, tile, key, options.alpha_sample, options.beta_sample, options.window, carried=True)
    if stored is None:
        stored = fit_species(_counted(sample, options), bands, key, options.n_iter, options.n_clusters, options.iqr_weight, options.starts, seed=options.seed, algorithm=options.algorithm)
        stored = stored.kept()
    return Model(stored, fit_beta(plots, stored, options, beta_ops.MAX_SHARED) if options.beta_metrics else None)


def tiled_diversity(pixels: DataFrame, bands: Sequence[str], tile: str, key: str, n_cols: int, options: Options, stored: SpeciesModel | None = None, n_stats: int | None = None) -> DataFrame:
    """Tiles from pixels to one map: masks by the bounds of all pixels (or of a sample), samples by tile, one model, every tile's windows.

    The result is the mosaic of all tiles, with their number; ``maps.write_map`` stores a folder a tile.
    """
    # Read for both samples, their ranks and the windows.
    masked = written(tile_masks(pixels.select(key, "r", "c", tile, *bands), bands, tile, key, options, n_stats), "masked-pixels")
    return apply_tiles(masked, tile, n_cols, fit_tiles(masked, bands, tile, key, options, stored), options)


def apply_tiles(pixels: DataFrame, tile: str, n_cols: int, model: Model | None, options: Options) -> DataFrame:
    """All tiles with a stored model; without one there is nothing to apply."""
    if model is None:
        report("no_stored_model")
    return evaluate(pixels, model, n_cols, options, tile)


def plot_diversity(pixels: DataFrame, plots: DataFrame, model: Model, options: Options) -> DataFrame:
    """Field plots with their attributes, alpha metrics, functional metrics, and two places each.

    ``pixels`` has ``plot_id`` and the bands, ``plots`` the attributes. ``full`` is the place in the model's
    ordination, ``own`` that in an ordination of the plots alone (at most ``MAX_TRAINING``).
    """
    key = ["plot_id"]
    species = alpha_ops.iteration_counts(assign_model(pixels, model.species, key), key)
    out = alpha_ops.alpha_iterations(species, key, options.alpha_metrics, options.hill_order, options.pcelim)
    if model.beta is not None:
        ssd = stacked_shares(species, key, options.n_clusters, options.n_iter, options.pcelim)
        full = beta_ops.project(ssd, model.beta.training, model.beta.coordinates, key, options.neighbours, options.n_iter)
        out = out.join(full.withColumnRenamed("coord", "full"), key, "left")
        own = ordinate(plot_dissimilarity(species, options.pcelim), species.select("plot_id"), "plot_id", options.dimensions)
        out = out.join(own.select("plot_id", F.col("coord").alias("own")), key, "left")
    if options.fd_metrics:
        out = out.join(fd_ops.functional(clean(pixels, model.species.bands), key, model.species.bands, options.fd_metrics), key, "left")
    return with_attributes(plots, out)


def plot_dissimilarity(counts: DataFrame, pcelim: float = alpha_ops.PCELIM) -> DataFrame:
    """``a``, ``b``, ``bc`` of all pairs of plots, averaged over the iterations of ``counts``."""
    sparse = beta_ops.species_shares(counts, ["plot_id", "iter"], pcelim)
    return beta_ops.mean_over_iterations(beta_ops.bray_curtis_pairs(sparse, "plot_id", ["iter"]))


def feature_criterion(sample: DataFrame, pixels: DataFrame, observed: DataFrame | Mapping[str, DataFrame], key: str, metric: str | None, options: Options, method: str = "spearman"):
    """The criterion of a forward selection: how metrics of plots, by candidate bands, follow what was observed.

    ``pixels`` has ``plot_id``; an observation has ``plot_id`` and ``value``, or for ``bc`` the pairs ``a``, ``b``, ``bc``, or the shares ``plot_id``, ``cid``, ``p``
    of any number of plots. A metric is an alpha metric, a functional one or ``bc``. ``observed`` is that of ``metric``, or one for each of several; species
    are fitted once for a candidate, whatever the number of metrics, and all candidates of a round are assigned in one pass over the pixels.
    """
    wanted = observed if isinstance(observed, Mapping) else {metric: observed}
    by_species, functional = [m for m in wanted if m not in fd_ops.METRICS], [m for m in wanted if m in fd_ops.METRICS]
    spark, same = pixels.sparkSession, sample is pixels
    pixels = written(pixels, "selection-pixels")
    sample = pixels if same else written(sample, "selection-sample")
    wanted = {m: written(frame, "observed") for m, frame in wanted.items()}

    def of_species(sets: list[list[str]]) -> Iterator[DataFrame]:
        fitted = lambda bands: fit_species(sample, bands, key, options.n_iter, options.n_clusters, options.iqr_weight, options.starts, seed=options.seed, algorithm=options.algorithm)
        # Side by side: the passes of a fit are short jobs one after another.
        with ThreadPoolExecutor(len(sets)) as pool:
            models = list(pool.map(fitted, sets))
        counts = written(several_counts(pixels, models, ["plot_id"]), "candidate-counts")
        shares = beta_ops.species_shares(counts, ["candidate", "plot_id", "iter"], options.pcelim)
        if "bc" in by_species and "cid" in wanted["bc"].columns:
            # Iterations of all candidates, numbered one after another.
            flat = shares.withColumn("iter", F.col("candidate") * options.n_iter + F.col("iter"))
            parts = [[i * options.n_iter + it for it in range(1, options.n_iter + 1)] for i in range(len(sets))]
            if method == "spearman":
                found = paired_ranks(flat, parts, options.n_clusters, wanted["bc"]).withColumnRenamed("part", "candidate")
            else:
                found = weighted_correlation(written(paired(flat, parts, options.n_clusters, wanted["bc"]), "pairs").withColumnRenamed("part", "candidate"), method, ["candidate"])
            yield found.withColumn("metric", F.lit("bc"))
        elif "bc" in by_species:
            each = [(i, plot_dissimilarity(counts.filter(F.col("candidate") == i).drop("candidate"), options.pcelim)) for i in range(len(sets))]
            yield from (mantel(pairs, wanted["bc"], method).select(F.lit(i).alias("candidate"), "n", "r", F.lit("bc").alias("metric")) for i, pairs in each)
        alpha = [m for m in by_species if m != "bc"]
        if alpha:
            found = written(alpha_ops.alpha_iterations(counts, ["candidate", "plot_id"], alpha, options.hill_order, options.pcelim), "candidate-alpha")
            yield from (correlation(found.join(wanted[m], "plot_id"), f"{m}_mean", "value", method, ["candidate"]).withColumn("metric", F.lit(m)) for m in alpha)

    def of_traits(i: int, bands: list[str]) -> Iterator[DataFrame]:
        found = written(fd_ops.functional(scale(pixels, iqr_bounds(sample, bands, options.iqr_weight), bands), ["plot_id"], bands, functional), "candidate-traits")
        yield from (correlation(found.join(wanted[m], "plot_id"), m, "value", method).select(F.lit(i).alias("candidate"), "n", "r", F.lit(m).alias("metric")) for m in functional)

    def criterion(sets: list[list[str]]) -> DataFrame:
        each = [x for i, bands in enumerate(sets) for x in of_traits(i, bands)] if functional else []
        each += of_species(sets) if by_species else []
        found = reduce(lambda a, b: a.unionByName(b), (x.select("candidate", "metric", "r") for x in each))
        # Candidates without a plot have a row too.
        rows = spark.createDataFrame([(i, m) for i in range(len(sets)) for m in wanted], "candidate int, metric string").join(found, ["candidate", "metric"], "left")
        return rows if isinstance(observed, Mapping) else rows.drop("metric")

    return criterion


@dataclass(frozen=True)
class SpectralModel:
    """How spectra become components: the rotation, the places of a continuum-removed spectrum that it takes, and which components are used."""

    rotation: Rotation
    places: tuple[int, ...]
    wavelengths: tuple[float, ...]
    continuum: bool
    selected: tuple[int, ...] | None = None

    def chosen(self) -> tuple[int, ...]:
        """The components chosen for what follows; without a choice there is nothing to go on with."""
        if not self.selected:
            report("pca_choice")
        return self.selected


def prepared_spectra(spectra: DataFrame, wavelengths: Sequence[float], key: str, column: str, continuum: bool) -> DataFrame:
    """``key``, ``x``: spectra without excluded domains, over their continuum if wanted."""
    if continuum:
        return continuum_removed(spectra, wavelengths, key, column).withColumnRenamed("cr", "x")
    kept = [i for i, w in enumerate(wavelengths) if not any(low < w < high for low, high in EXCLUDED_DOMAINS)]
    return spectra.select(key, F.transform(F.array(*map(F.lit, kept)), lambda i: F.get(column, i).cast("double")).alias("x"))


def fit_components(spectra: DataFrame, wavelengths: Sequence[float], key: str, column: str, n_sample: int = 1_000_000, standardize: bool = True, keep: int | None = None, continuum: bool = True, selected: Sequence[int] | None = None) -> SpectralModel:
    """Excluded domains, continuum removal, constant bands, then (standardised) components of a sample of pixels."""
    sample = prepared_spectra(sample_pixels(spectra.select(key, column), n_sample, key), wavelengths, key, column, continuum)
    rotation, places = fit_array_pca(sample, "x", standardize, keep, 1e-12)
    return SpectralModel(rotation, tuple(places), tuple(wavelengths), continuum, tuple(selected) if selected else None)


def components(spectra: DataFrame, model: SpectralModel | None, key: str, column: str) -> DataFrame:
    """``key`` and the components (those chosen, if any were) of every pixel by a stored model."""
    if model is None:
        report("no_pca")
    x = prepared_spectra(spectra, model.wavelengths, key, column, model.continuum)
    return rotate_array(x, model.rotation, model.places, "x", [key], model.selected)


def species_map(pixels: DataFrame, model: SpeciesModel, keys: Sequence[str], mask: str | None = None) -> DataFrame:
    """``keys``, ``cid``: the species of every valid pixel by the first set of centroids."""
    valid = pixels if mask is None else pixels.filter(F.col(mask) == 1)
    return assign_model(valid, model, keys).select(*keys, F.get("species", F.lit(0)).alias("cid"))


def class_numbers(pixels: DataFrame, column: str) -> DataFrame:
    """``class``, ``cid``: classes as dense numbers from 1. A row a class."""
    return pixels.select(F.col(column).alias("class")).filter("class is not null").distinct().withColumn("cid", F.dense_rank().over(Window.orderBy("class")))


def class_diversity(pixels: DataFrame, column: str, keys: Sequence[str], options: Options) -> DataFrame:
    """Alpha diversity where a pixel's class is its species, by each window's own size."""
    counts = alpha_ops.species_counts(pixels.filter(F.col(column).isNotNull()), keys, column)
    return alpha_ops.alpha(counts, keys, options.alpha_metrics, options.hill_order, options.pcelim, options.min_sun * options.window**2)


def class_beta(pixels: DataFrame, column: str, keys: Sequence[str], options: Options) -> DataFrame:
    """``keys``, ``coord``: places of windows in an ordination of up to ``beta_sample`` of them, by their classes.

    Windows are sampled in hash order; the sample is bounded (``MAX_TRAINING``, checked where it is used).
    """
    numbers = class_numbers(pixels, column)
    own = pixels.join(numbers.withColumnRenamed("class", column), column)
    counts = enough_pixels(alpha_ops.species_counts(own, keys, "cid"), keys, options.min_sun * options.window**2)
    ssd = beta_ops.dense(beta_ops.species_shares(counts, keys, options.pcelim), keys, numbers.count())
    rows = ssd.orderBy(F.xxhash64(*keys, F.lit(options.seed)), *keys).limit(min(options.beta_sample, beta_ops.MAX_TRAINING + 1)).collect()
    if not rows:
        return ssd.select(*keys, F.array().cast("array<double>").alias("coord"))
    training = np.array([r.ssd for r in rows], float)
    places = principal_coordinates(beta_ops.bray_curtis_matrix(training, training), options.dimensions)[0]
    return beta_ops.project(ssd, training, places, keys, options.neighbours)


def moving_diversity(pixels: DataFrame, column: str, options: Options, keep: Sequence[str] = ()) -> DataFrame:
    """Alpha diversity of the neighbourhood of every pixel."""
    counts = moving_counts(pixels, column, options.window, keep=keep).withColumnRenamed(column, "cid")
    return alpha_ops.alpha(counts, [*keep, "r", "c"], options.alpha_metrics, options.hill_order, options.pcelim, options.min_sun * options.window**2)


def abundance_diversity(abundance: DataFrame, site: str, options: Options, training: DataFrame | None = None, coordinates: DataFrame | None = None, axes: Sequence[str] = ()) -> DataFrame:
    """Diversity of abundances (``site``, ``cid``, ``n``), with places in the ordination of training sites if given."""
    out = alpha_ops.alpha(abundance, [site], options.alpha_metrics, options.hill_order, 0.0)
    layers = abundance.groupBy(site).agg(F.count(F.lit(1)).alias("layers"))
    out = out.join(layers, site)
    if training is None:
        return out
    shares = beta_ops.species_shares(abundance, [site], 0.0)
    return out.join(beta_ops.project_shares(shares, training, coordinates, site, axes, options.neighbours), site, "left")
