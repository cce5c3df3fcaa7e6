"""Windows of pixels: fixed cells, moving neighbourhoods, tiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def window_id(row: Column, col: Column, width: int, n_cols: int) -> Column:
    """Row-major number, from 1, of the ``width``-square cell that a pixel lies in; cells at the right and lower edge may be partial."""
    return (F.floor(row / width) * -(-n_cols // width) + F.floor(col / width) + 1).cast("bigint")


def tile_id(row: Column, height: int) -> Column:
    return F.floor(row / height).cast("bigint")


def coarse(index: Column, factor: int) -> Column:
    """The coarse row or column of a fine one (nearest-neighbour resampling)."""
    return F.floor(index / factor).cast("bigint")


def enough_pixels(counts: DataFrame, keys: Sequence[str], least: float, strict: bool = True) -> DataFrame:
    """Rows of ``counts`` (an ``n`` each) of groups with more than ``least`` pixels, at least as many if not ``strict``."""
    total = counts.groupBy(*keys).agg(F.sum("n").alias("_n"))
    test = F.col("_n") > least if strict else F.col("_n") >= least
    return counts.join(total.filter(test).select(*keys), list(keys), "left_semi")


def offsets(width: int) -> tuple[int, int]:
    """First and last offset of a neighbourhood: symmetric for an odd width, one more before the centre for an even one."""
    return -(width // 2), (width - 1) // 2


def moving_counts(pixels: DataFrame, species: str, width: int, row: str = "r", col: str = "c", keep: Sequence[str] = ()) -> DataFrame:
    """``r``, ``c``, the species and ``n``: how many pixels of each species lie around each pixel.

    Counts add up, so rows are spread first and columns after: a pixel makes ``2 * width``
    rows and not ``width`` squared, and the first aggregation shrinks what the second
    spreads. Neighbourhoods are cut at the edges; only existing pixels are centres.
    """
    low, high = offsets(width)
    spread = F.explode(F.sequence(F.lit(-high), F.lit(-low)))
    keys = list(keep)
    down = pixels.select(*keys, F.col(row), F.col(col).alias("c"), F.col(species), spread.alias("_d")).withColumn("r", F.col(row) + F.col("_d"))
    down = down.groupBy(*keys, "r", "c", species).agg(F.count(F.lit(1)).alias("n"))
    across = down.select(*keys, "r", F.col("c").alias("_c"), species, "n", spread.alias("_d")).withColumn("c", F.col("_c") + F.col("_d"))
    counts = across.groupBy(*keys, "r", "c", species).agg(F.sum("n").alias("n"))
    centres = pixels.select(*keys, F.col(row).alias("r"), F.col(col).alias("c")).distinct()
    return counts.join(centres, [*keys, "r", "c"], "left_semi")


def without_border(cells: DataFrame, width: int, n_rows: int, n_cols: int, row: str = "r", col: str = "c") -> DataFrame:
    """Cells further than half a window from every edge."""
    margin = 1 + width // 2
    return cells.filter(F.col(row).between(margin, n_rows - 1 - margin) & F.col(col).between(margin, n_cols - 1 - margin))


def extent(pixels: DataFrame, row: str = "r", col: str = "c") -> DataFrame:
    """One row: the bounding rectangle."""
    return pixels.agg(F.min(row).alias("r_min"), F.max(row).alias("r_max"), F.min(col).alias("c_min"), F.max(col).alias("c_max"))


def grid(pixels: DataFrame, cell: int, row: str = "r", col: str = "c") -> DataFrame:
    """Square cells of ``cell`` pixels over the extent that hold a pixel, with their bounds and number of pixels."""
    box = extent(pixels, row, col).first()  # one row
    top, left = (box.r_min or 0), (box.c_min or 0)
    keyed = pixels.select(F.floor((F.col(row) - top) / cell).cast("bigint").alias("cell_r"), F.floor((F.col(col) - left) / cell).cast("bigint").alias("cell_c"))
    cells = keyed.groupBy("cell_r", "cell_c").agg(F.count(F.lit(1)).alias("n"))
    low_r, low_c = F.col("cell_r") * cell + top, F.col("cell_c") * cell + left
    return cells.select("cell_r", "cell_c", low_r.alias("r_min"), (low_r + cell - 1).alias("r_max"), low_c.alias("c_min"), (low_c + cell - 1).alias("c_max"), "n")
