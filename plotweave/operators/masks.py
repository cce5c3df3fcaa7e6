"""Which pixels and bands count: cleaning, outliers, radiometric thresholds, band selection."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.operators.bounded import small

# Wavelengths (nm) of water vapour absorption and noise, left out of spectra.
EXCLUDED_DOMAINS = ((0, 400), (895, 1005), (1320, 1480), (1780, 2040), (2450, 2600))
NDVI_LEAST, BLUE_MOST, NIR_LEAST = 0.65, 500.0, 1500.0
BLUE_NM, RED_NM, NIR_NM = 480, 670, 835
#: Accuracy of the sketch that narrows quartiles down; and values that are counted without one.
ACCURACY, SMALL = 1 << 16, 100_000


def finite(column: str) -> Column:
    """Neither null, NaN nor infinite."""
    c = F.col(column).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def clean(pixels: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Pixels whose bands are all finite."""
    # NaN is above infinity, and nothing is known of null: one comparison tells all, and keeps the code of many bands short.
    return pixels.filter(reduce(and_, (F.abs(F.col(b).cast("double")) < float("inf") for b in bands)))


def _array(bands: Sequence[str]) -> Column:
    return F.array(*(F.col(b).cast("double") for b in bands))


def iqr_bounds(pixels: DataFrame, bands: Sequence[str], weight: float = 3.0, keys: Sequence[str] = (), approximate: int | None = None) -> DataFrame:
    """``band``, ``low``, ``high``: quartiles widened by ``weight`` interquartile ranges.

    Exact interpolated quartiles, or with ``approximate`` (an accuracy) a sketch's.
    """
    found = _sketched(pixels, bands, keys, approximate) if approximate else quartiles(pixels, bands, keys)
    reach = (F.col("q3") - F.col("q1")) * weight
    return found.select(*keys, "band", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))


def _long(pixels: DataFrame, bands: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """``keys``, ``band``, ``value``, null where it isn't finite."""
    each = pixels.select(*keys, F.posexplode(_array(bands)).alias("_at", "_value"))
    name = F.element_at(F.lit(list(bands)), F.col("_at") + 1)
    return each.select(*keys, name.alias("band"), F.when(F.abs("_value") < float("inf"), F.col("_value")).alias("value"))


def _sketched(pixels: DataFrame, bands: Sequence[str], keys: Sequence[str], accuracy: int) -> DataFrame:
    found = _long(pixels, bands, keys).groupBy(*keys, "band").agg(F.percentile_approx("value", [0.25, 0.75], accuracy).alias("q"))
    return found.select(*keys, "band", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))


def quartiles(pixels: DataFrame, bands: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``keys``, ``band``, ``q1``, ``q3``: exact interpolated quartiles.

    A sketch gives a range that surely holds the wanted order statistics: a few ``1 / ACCURACY`` of all
    values. Only values in it are counted one by one; of those below just the number matters. So no
    aggregate holds all values of a band. Up to ``SMALL`` values are counted all.
    """
    margin = 3 / ACCURACY
    long = _long(pixels, bands, keys)
    around = [q + d for q in (0.25, 0.75) for d in (-margin, margin)]
    sketch = long.groupBy(*keys, "band").agg(F.count("value").alias("n"), F.percentile_approx("value", around, ACCURACY).alias("a"))
    few, ends = F.col("n") <= SMALL, F.lit(float("inf"))
    limits = F.array(*(F.struct(F.lit(q).alias("q"), F.when(few, -ends).otherwise(F.col("a")[k]).alias("from"), F.when(few, ends).otherwise(F.col("a")[k + 1]).alias("to")) for q, k in ((0.25, 0), (0.75, 2))))
    ranges = sketch.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("band").alias("_band"), "n", F.explode(limits).alias("x")).select("*", "x.*").drop("x")
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in (*keys, "band")))
    names = [f"_{k}" for k in (*keys, "band")]
    inside = long.filter("value is not null").join(small(ranges), same).filter(F.col("value") <= F.col("to"))  # two rows a band and key
    counted = inside.groupBy(*names, "q", "n", F.when(F.col("value") >= F.col("from"), F.col("value")).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    upto = counted.withColumn("upto", F.sum("c").over(Window.partitionBy(*names, "q").orderBy(F.asc_nulls_first("v"))))
    place = F.col("q") * (F.col("n") - 1)
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    found = upto.groupBy(*names, "q", "n").agg(at(F.floor(place)).alias("low"), at(F.ceil(place)).alias("high"))
    value = F.when(F.ceil(place) == F.floor(place), F.col("low")).otherwise((F.ceil(place) - place) * F.col("low") + (place - F.floor(place)) * F.col("high"))
    each = found.groupBy(*names).agg(F.max(F.when(F.col("q") == 0.25, value)).alias("q1"), F.max(F.when(F.col("q") == 0.75, value)).alias("q3"))
    return sketch.join(each, same, "left").select(*keys, "band", "q1", "q3")


def within(pixels: DataFrame, bounds: DataFrame, bands: Sequence[str], mask: str | None = None) -> DataFrame:
    """``pixels`` with ``mask``: 1 where every band is within its bounds (and the given mask is 1), else 0."""
    found = {r.band: (r.low, r.high) for r in bounds.select("band", "low", "high").collect()}  # a row a band
    # Of an empty table nothing is known, and nothing is within.
    test = reduce(and_, (finite(b) & F.col(b).between(*map(F.lit, found.get(b, (None, None)))) for b in bands))
    if mask is not None:
        test = test & F.coalesce(F.col(mask) == 1, F.lit(False))
    return pixels.withColumn("mask", F.when(test, 1).otherwise(0))


def tile_mask(pixels: DataFrame, bounds: DataFrame, bands: Sequence[str]) -> DataFrame:
    """As ``within``, but with null for masked pixels, as tiles store it."""
    return within(pixels, bounds, bands).withColumn("mask", F.when(F.col("mask") == 1, 1))


def band_catalog(spectra: DataFrame, wavelengths: Sequence[float], features: str | None = None) -> DataFrame:
    """``ix`` (from 0), ``wl``. With ``features``, an array column, the bands that the spectra have: those of another number of bands raise."""
    bands = [(i, float(w)) for i, w in enumerate(wavelengths)]
    if features is not None:
        sizes = spectra.agg(F.min(F.size(features)).alias("least"), F.max(F.size(features)).alias("most")).first()
        if sizes.most is not None and not sizes.least == sizes.most == len(wavelengths):
            raise ValueError(f"spectra of {sizes.least} to {sizes.most} bands, {len(wavelengths)} wavelengths")
        bands = bands[: sizes.most or 0]
    return spectra.sparkSession.createDataFrame(bands, "ix int, wl double")


def nearest_bands(catalog: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target (``name``, ``target``) the band next to it, the first on ties, and its distance."""
    gap = F.abs(F.col("wl") - F.col("target"))
    pairs = catalog.crossJoin(F.broadcast(targets)).withColumn("gap", gap)  # bands by a handful of targets
    return pairs.groupBy("name").agg(F.min_by("ix", F.struct("gap", "ix")).alias("ix"), F.min("gap").alias("distance"))


def keep_bands(catalog: DataFrame, domains: Iterable[tuple[float, float]] = EXCLUDED_DOMAINS) -> DataFrame:
    """Bands outside all excluded intervals (their ends are kept)."""
    return catalog.filter(reduce(and_, (~((F.col("wl") > low) & (F.col("wl") < high)) for low, high in domains)))


def invariant_bands(pixels: DataFrame, bands: Sequence[str]) -> DataFrame:
    """``band``, ``sd``, ``invariant`` over pixels whose bands are all finite, in one pass."""
    found = _long(clean(pixels, bands), bands, ()).groupBy("band").agg(F.stddev_samp("value").alias("sd"))
    named = pixels.sparkSession.createDataFrame([(b,) for b in bands], "band string")
    return named.join(found, "band", "left").withColumn("invariant", F.coalesce(F.col("sd") == 0, F.lit(True)))


def drop_invariant(pixels: DataFrame, bands: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Pixels whose bands are all finite, without constant bands; the bands left."""
    constant = {r.band for r in invariant_bands(pixels, bands).filter("invariant").collect()}
    return clean(pixels, bands).drop(*constant), [b for b in bands if b not in constant]


def ndvi(nir: Column, red: Column) -> Column:
    return F.try_divide(nir - red, nir + red)


def radiometric_mask(blue: Column, red: Column, nir: Column, mask: Column | None = None, ndvi_least: float = NDVI_LEAST, blue_most: float = BLUE_MOST, nir_least: float = NIR_LEAST) -> Column:
    """0 for shade (low NIR), haze and cloud (high blue), bare ground (low NDVI) and what is masked already; else 1."""
    index = ndvi(nir, red)
    bad = (nir < nir_least) | (blue > blue_most) | index.isNull() | (index < ndvi_least)
    if mask is not None:
        bad = bad | (F.coalesce(mask, F.lit(0)) == 0)
    return F.when(F.coalesce(bad, F.lit(True)), 0).otherwise(1)


def check_bands(catalog: DataFrame) -> DataFrame:
    """One row of flags: are all wavelengths numbers, are they in nanometres, are they distinct and rising?"""
    return catalog.agg(F.bool_and(finite("wl")).alias("numeric"), (F.max("wl") >= 40).alias("nanometres"), (F.count_distinct("wl") == F.count(F.lit(1))).alias("distinct_wl"), F.count(F.lit(1)).alias("n_bands"))


def require_bands(catalog: DataFrame) -> None:
    """Raise where ``check_bands`` finds a fault."""
    flags = check_bands(catalog).first().asDict()
    wrong = [k for k in ("numeric", "nanometres") if not flags[k]]
    if wrong:
        raise ValueError(f"wavelengths are not {' and not '.join(wrong)}")


def valid_pixels(pixels: DataFrame, key: str, band: str, mask: str | None = None) -> DataFrame:
    """``key``, ``n_valid``: pixels of each tile with a finite value, and mask 1."""
    test = finite(band) if mask is None else finite(band) & (F.col(mask) == 1)
    return pixels.groupBy(key).agg(F.count(F.when(test, 1)).alias("n_valid"))


def named(bands: Mapping[str, str]) -> list[Column]:
    """Bands under a sensor's names."""
    return [F.col(old).alias(new) for old, new in bands.items()]
