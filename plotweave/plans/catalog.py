"""Every registered query of the diversity engine, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plotweave.plans import abundance_queries, grid_queries, model_queries, name_queries, polygon_queries, raster_queries, spectra_queries

_MODULES = (grid_queries, spectra_queries, abundance_queries, name_queries, model_queries, raster_queries, polygon_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: q for m in _MODULES for k, q in m.ORACLE_SQL.items()}
