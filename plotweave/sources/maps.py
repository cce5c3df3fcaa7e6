"""Maps: pixel tables in, result tables out."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pixels(spark: SparkSession, path: str, bands: Sequence[str] | None = None, rows: tuple[int, int] | None = None) -> DataFrame:
    """A pixel table (``r``, ``c``, bands); bands and a range of rows are pruned in the scan."""
    pixels = spark.read.parquet(path)
    if bands is not None:
        pixels = pixels.select("r", "c", *bands)
    return pixels if rows is None else pixels.filter(F.col("r").between(*rows))


def stack(layers: Sequence[DataFrame], on: Sequence[str] = ("r", "c")) -> DataFrame:
    """Layers of one grid side by side, joined on the pixel."""
    return reduce(lambda a, b: a.join(b, list(on)), layers)


def write_map(results: DataFrame, path: str, tile: str | None = None, mode: str = "overwrite") -> None:
    """Results as Parquet, a folder a tile; writing a tile again replaces that tile only."""
    writer = results.write.mode(mode).option("compression", "zstd")
    if tile is not None:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(tile)
    writer.parquet(path)


def long_map(results: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """``keys``, ``metric``, ``value``: one layer a metric."""
    return results.unpivot(list(keys), list(metrics), "metric", "value")


def wide_map(layers: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return layers.groupBy(*keys).pivot("metric", list(metrics)).agg(F.first("value"))


def mosaic(tiles: Sequence[DataFrame]) -> DataFrame:
    """All tiles in one frame; inputs are left as they are."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tiles)


def compact(results: DataFrame, path: str, files: int) -> None:
    """Rewrite a mosaic in fewer, compressed files, elsewhere: a path that ``results`` reads raises, as its rows would be lost."""
    plain = lambda p: "/" + re.sub(r"^[a-z0-9]+:/+", "", p.rstrip("/")).lstrip("/") + "/"
    if any(plain(f).startswith(plain(path)) for f in results.inputFiles()):
        raise ValueError(f"{path} is what the map reads")
    results.coalesce(files).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_table(results: DataFrame, path: str, digits: int = 5) -> None:
    """Tab-separated text with rounded numbers."""
    columns: list[Column] = [F.round(f.name, digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in results.schema]
    results.select(*columns).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def scatter_points(results: DataFrame, alpha: str, coord: str, classes: str) -> DataFrame:
    """What a scatter plot of three ordination axes shows: the axes, the size and the class of each point."""
    return results.select(*(F.get(coord, F.lit(k)).alias(f"pcoa_{k + 1}") for k in range(3)), F.col(alpha).alias("size"), F.col(classes).alias("class"))
