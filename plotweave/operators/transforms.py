"""Spectral transforms: scaling, indices, continuum removal, noise."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.operators.masks import EXCLUDED_DOMAINS


def scale(pixels: DataFrame, bounds: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Bands as (value - low) / (high - low); a band without range raises."""
    found = {r.band: (r.low, r.high) for r in bounds.select("band", "low", "high").collect()}  # a row a band
    flat = [b for b in bands if found[b][0] == found[b][1]]
    if flat:
        raise ValueError(f"bands without range: {', '.join(flat)}")
    return pixels.withColumns({b: (F.col(b) - found[b][0]) / (found[b][1] - found[b][0]) for b in bands})


def ndvi(nir: Column, red: Column) -> Column:
    return F.try_divide(nir - red, nir + red)


def cr_swir(b8a: Column, b11: Column, b12: Column, wl: tuple[float, float, float] = (864.8, 1613.7, 2202.4)) -> Column:
    """The middle band over the straight line between the outer ones."""
    line = b8a + (b12 - b8a) * ((wl[1] - wl[0]) / (wl[2] - wl[0]))
    return F.try_divide(b11, line)


def lai_savi(nir: Column, red: Column) -> Column:
    """Leaf area from the soil-adjusted index; null outside the logarithm's domain."""
    inner = F.lit(0.371) + F.lit(1.5) * F.try_divide(nir - red, nir + red + F.lit(0.5))
    return -F.log(F.when(inner > 0, inner)) / F.lit(2.4)


INDICES = {"ndvi": (ndvi, ("nir", "red")), "cr_swir": (cr_swir, ("b8a", "b11", "b12")), "lai_savi": (lai_savi, ("nir", "red"))}


def spectral_indices(pixels: DataFrame, names: Sequence[str], bands: dict[str, Column], mask: Column | None = None) -> DataFrame:
    """``pixels`` with a column for each index, null where the mask isn't 1."""
    found = {n: INDICES[n][0](*(bands[b] for b in INDICES[n][1])) for n in names}
    return pixels.withColumns({n: x if mask is None else F.when(mask == 1, x) for n, x in found.items()})


def hull_points(x: np.ndarray, wl: np.ndarray) -> list[int]:
    """Bands on the upper convex hull of a spectrum."""
    keep: list[int] = []
    for i in range(len(x)):
        while len(keep) > 1:
            a, b = keep[-2:]
            if (x[b] - x[a]) * (wl[i] - wl[a]) > (x[i] - x[a]) * (wl[b] - wl[a]):
                break
            keep.pop()
        keep.append(i)
    return keep


def cubic_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The interpolating cubic spline whose outer pieces have the third derivative of the cubic through four end points."""
    n = len(x)
    if n < 3:
        return np.interp(at, x, y)
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    system, right = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        system[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        right[i] = 6 * (d[i] - d[i - 1])
    for row, first, piece in ((0, 0, 0), (n - 1, n - 4, n - 2)):
        system[row, piece : piece + 2] = -1 / h[piece], 1 / h[piece]
        if n > 3:
            p, q = x[first : first + 4], d[first : first + 3]
            second = (np.diff(q)) / (p[2:] - p[:-2])
            right[row] = 6 * (second[1] - second[0]) / (p[3] - p[0])
    m = np.linalg.solve(system, right)
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    a, b = x[k + 1] - at, at - x[k]
    return (m[k] * a**3 + m[k + 1] * b**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * a + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * b


def upper_hull(x: np.ndarray, wl: np.ndarray, spline: bool = False) -> np.ndarray:
    """The upper convex hull of a spectrum at all its wavelengths, its points joined by lines or a spline."""
    keep = hull_points(x, wl)
    return cubic_spline(wl[keep], x[keep], wl) if spline else np.interp(wl, wl[keep], x[keep])


def remove_continuum(x: np.ndarray, wl: np.ndarray, absorbance: bool = False, subtract: bool = False, spline: bool = False) -> np.ndarray:
    """A spectrum over its hull, or 1 plus their difference; absorbances are inverted before and after."""
    values = 1 / x if absorbance else x
    hull = upper_hull(values, wl, spline)
    out = 1 + values - hull if subtract else np.divide(values, hull, out=np.zeros_like(values), where=hull != 0)
    return 1 / out - 1 if absorbance else out


def continuum_removed(spectra: DataFrame, wavelengths: Sequence[float], key: str, column: str = "spectrum", domains: Sequence[tuple[float, float]] = EXCLUDED_DOMAINS, absorbance: bool = False, subtract: bool = False, spline: bool = False) -> DataFrame:
    """``key``, ``cr``: spectra without excluded domains, negatives as 0, over their hull, first and last band dropped.

    With ``subtract``, 1 plus the difference to the hull; with ``absorbance``, the hull is that of the inverse; with
    ``spline``, the hull's points are joined by a cubic. A constant spectrum, and one with a missing value (or, as
    absorbance, a zero), gives zeros. Runs in Arrow batches, whose size bounds the memory.
    """
    wl = np.array(wavelengths, float)
    use = np.array([not any(low < w < high for low, high in domains) for w in wl])
    kept = wl[use]
    kind = spectra.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for spectrum in batch[column]:
                x = np.full(len(wl), np.nan) if spectrum is None else np.asarray(spectrum, float)
                x = np.maximum(x[use], 0)
                good = len(x) > 2 and np.isfinite(x).all() and x.min() < x.max() and not (absorbance and x.min() == 0)
                rows.append(remove_continuum(x, kept, absorbance, subtract, spline)[1:-1] if good else np.zeros(max(0, len(kept) - 2)))
            yield pd.DataFrame({key: batch[key], "cr": rows})

    return spectra.select(key, column).mapInPandas(run, f"`{key}` {kind}, cr array<double>")


def noise(pixels: DataFrame, bands: Sequence[str], row: str = "r", col: str = "c", keys: Sequence[str] = ()) -> DataFrame:
    """``r``, ``c`` and, per band, the mean of its differences to the pixels above and to the left.

    Two equi-joins with shifted coordinates, so gaps in the grid are left out and no
    window holds a whole row.
    """
    names = list(keys)
    here = pixels.select(*names, F.col(row).alias("r"), F.col(col).alias("c"), *bands)
    moved = lambda dr, dc, end: pixels.select(*names, (F.col(row) + dr).alias("r"), (F.col(col) + dc).alias("c"), *(F.col(b).alias(f"{b}{end}") for b in bands))
    on = [*names, "r", "c"]
    both = here.join(moved(1, 0, "_up"), on).join(moved(0, 1, "_left"), on)
    return both.select(*on, *(((F.col(b) - F.col(f"{b}_up") + F.col(b) - F.col(f"{b}_left")) / 2).alias(b) for b in bands))


def noise_by_lag(pixels: DataFrame, bands: Sequence[str], row: str = "r", col: str = "c") -> DataFrame:
    """The same on a grid without gaps, with window functions."""
    across, down = Window.partitionBy(row).orderBy(col), Window.partitionBy(col).orderBy(row)
    out = pixels.select(F.col(row).alias("r"), F.col(col).alias("c"), *(((2 * F.col(b) - F.lag(b).over(across) - F.lag(b).over(down)) / 2).alias(b) for b in bands))
    return out.dropna(subset=list(bands))
