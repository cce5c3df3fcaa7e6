"""Lengths on the ellipsoid as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Half axis (metres) and flattening of the WGS 84 ellipsoid.
HALF_AXIS, FLATTENING = 6378137.0, 1 / 298.257223563
_E2 = FLATTENING * (2 - FLATTENING)


def degree_of_latitude(latitude: Column) -> Column:
    """Metres of a degree along the meridian at a latitude (degrees)."""
    s = F.sin(F.radians(latitude))
    return F.lit(math.pi / 180 * HALF_AXIS * (1 - _E2)) / F.pow(1 - _E2 * s * s, F.lit(1.5))


def degree_of_longitude(latitude: Column) -> Column:
    """Metres of a degree along the parallel at a latitude (degrees)."""
    s = F.sin(F.radians(latitude))
    return F.lit(math.pi / 180 * HALF_AXIS) * F.cos(F.radians(latitude)) / F.sqrt(1 - _E2 * s * s)
