"""Bands under a sensor's names, masks of another resolution, and spectral indices tile by tile."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.operators.bounded import small
from plotweave.operators.masks import radiometric_mask
from plotweave.operators.transforms import INDICES, spectral_indices
from plotweave.operators.windows import coarse

# Bands of sensors in the order of their products, by resolution in metres, and which serve as blue, red and near infrared.
SENTINEL_2 = {10: ("B02", "B03", "B04", "B05", "B06", "B07", "B08", "B8A", "B11", "B12"), 20: ("B02", "B03", "B04", "B05", "B06", "B07", "B8A", "B11", "B12")}
LANDSAT = {30: ("B01", "B02", "B03", "B04", "B05", "B07")}
ROLES = {"sentinel-2": {10: ("B02", "B04", "B08"), 20: ("B02", "B04", "B8A")}, "landsat": {30: ("B01", "B03", "B04")}}
BANDS_OF = {"sentinel-2": SENTINEL_2, "landsat": LANDSAT}
# Thresholds that keep all pixels.
ALL_NDVI, ALL_BLUE, ALL_NIR = -1.0, float("inf"), float("-inf")


def sensor_named(name: str) -> str:
    """A sensor by any of its usual names."""
    plain = name.lower().replace("_", "").replace("-", "").replace(" ", "")
    if plain in ("s2", "sentinel2"):
        return "sentinel-2"
    if plain in ("landsat", "landsat7", "landsat8", "landsat9"):
        return "landsat"
    raise ValueError(f"no sensor {name}")


def named_bands(pixels: DataFrame, bands: Sequence[str], sensor: str, resolution: int) -> DataFrame:
    """``pixels`` with its bands, in the order of the product, under the sensor's names, and ``blue``, ``red``, ``nir``."""
    kind = sensor_named(sensor)
    names = BANDS_OF[kind].get(resolution)
    if names is None or len(names) != len(bands):
        raise ValueError(f"{kind} has no {len(bands)} bands of {resolution} m")
    roles = dict(zip(("blue", "red", "nir"), ROLES[kind][resolution], strict=True))
    source = dict(zip(names, bands, strict=True))
    rest = [c for c in pixels.columns if c not in bands]
    return pixels.select(*rest, *(F.col(old).cast("double").alias(new) for new, old in source.items()), *(F.col(source[b]).cast("double").alias(role) for role, b in roles.items()))


def resampled_mask(pixels: DataFrame, mask: DataFrame, factor: int) -> DataFrame:
    """``pixels`` with ``mask``: that of the coarse cell (``r``, ``c``) that each pixel lies in, null where there is none."""
    cells = mask.select(F.col("r").alias("_r"), F.col("c").alias("_c"), F.col("mask").cast("int").alias("mask"))
    return pixels.join(small(cells), (coarse(F.col("r"), factor) == F.col("_r")) & (coarse(F.col("c"), factor) == F.col("_c")), "left").drop("_r", "_c")


def index_tiles(pixels: DataFrame, bands: Sequence[str], indices: Sequence[str] = tuple(INDICES), sensor: str = "sentinel-2", resolution: int = 10, mask: DataFrame | None = None, factor: int = 1, ndvi_least: float = ALL_NDVI, blue_most: float = ALL_BLUE, nir_least: float = ALL_NIR, tile: str = "tile") -> DataFrame:
    """``tile``, ``r``, ``c``, ``mask`` (0 or 1) and the indices of reflectances, null where masked.

    The mask has the given one, of cells ``factor`` times as large, and the radiometric thresholds; those not given keep all pixels.
    ``rasters.write_mosaic`` stores the result by tile.
    """
    named = named_bands(pixels, bands, sensor, resolution)
    given: Column | None = None
    if mask is not None:
        named, given = resampled_mask(named, mask, factor), F.col("mask")
    ok = named.withColumn("mask", radiometric_mask(F.col("blue"), F.col("red"), F.col("nir"), given, ndvi_least, blue_most, nir_least))
    roles: Mapping[str, Column] = {"red": F.col("red"), "nir": F.col("nir"), **{k: F.col(b) for k, b in (("b8a", "B8A"), ("b11", "B11"), ("b12", "B12")) if b in ok.columns}}
    missing = [n for n in indices if not set(INDICES[n][1]) <= set(roles)]
    if missing:
        raise ValueError(f"{sensor} lacks bands of {', '.join(missing)}")
    return spectral_indices(ok, list(indices), dict(roles), F.col("mask")).select(tile, "r", "c", "mask", *indices)
