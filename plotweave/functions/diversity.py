"""Diversity expressions over the shares of species in a group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def shannon(p: Column) -> Column:
    """Shannon entropy, an aggregate of positive shares that sum to 1."""
    return F.lit(0.0) - F.sum(p * F.log(p))


def simpson(p: Column) -> Column:
    return F.lit(1.0) - F.sum(p * p)


def hill(p: Column, q: float) -> Column:
    """Hill number of order ``q``: richness at 0, the exponential of Shannon's entropy at 1."""
    if q == 0:
        return F.count(p).cast("double")
    if q == 1:
        return F.exp(shannon(p))
    return F.pow(F.sum(F.pow(p, F.lit(float(q)))), F.lit(1 / (1 - q)))


def solve_fisher(species: np.ndarray, individuals: np.ndarray) -> np.ndarray:
    """Fisher's alpha: the root of ``S = a * log(1 + N / a)``; NaN where there is none (S < 2 or S >= N).

    Bisection on the logarithm of ``a``, all groups at once.
    """
    s, n = species.astype(float), individuals.astype(float)
    ok = (s > 1) & (n > s)
    low, high = np.full(len(s), -20.0), np.full(len(s), 40.0)
    for _ in range(120):
        mid = (low + high) / 2
        a = np.exp(mid)
        below = a * np.log1p(np.where(ok, n, 1.0) / a) < s
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return np.where(ok, np.exp((low + high) / 2), np.nan)


def _fisher(species: pd.Series, individuals: pd.Series) -> pd.Series:
    found = solve_fisher(species.fillna(0).to_numpy(), individuals.fillna(0).to_numpy())
    return pd.Series(found).where(~np.isnan(found), None)


def fisher_alpha(species: Column | str, individuals: Column | str) -> Column:
    """Fisher's alpha of a richness and a number of individuals; null where undefined."""
    return F.pandas_udf(_fisher, "double")(species, individuals)


def mean_all(x: Column) -> Column:
    """The mean, null if any value is."""
    return F.when(F.count(x) == F.count(F.lit(1)), F.avg(x))


def sd_all(x: Column) -> Column:
    """The sample standard deviation, null if any value is."""
    return F.when(F.count(x) == F.count(F.lit(1)), F.stddev_samp(x))


def pearson(x: Column, y: Column) -> Column:
    """Pearson's correlation, null where one side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
