"""Samples of pixels and plots that don't depend on how the data are partitioned.

The order of a draw is a seeded hash of the identifier, or any column given; ties go by
the identifier. Exact sizes come from a distributed top-k or a rank within the tile.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.functions.geodesy import degree_of_latitude, degree_of_longitude
from plotweave.operators.bounded import small
from plotweave.operators.windows import extent

#: A tile's order is cut into ``STEPS`` squared ranges.
STEPS = 16
#: Tiles whose cuts are broadcast at most.
MAX_TILES = 5_000


def hash_order(key: str, seed: int = 0) -> Column:
    return F.xxhash64(F.col(key), F.lit(seed))


def pixels_per_iteration(pixels: DataFrame, n_iter: int, n_pixels: int, mask: str | None = None) -> int:
    """Pixels of each lot: the wanted or the valid number, whichever is less, over the lots."""
    valid = pixels if mask is None else pixels.filter(F.col(mask) == 1)
    return min(n_pixels, valid.count()) // n_iter


def sample_pixels(pixels: DataFrame, n: int, key: str, order: Column | None = None, mask: str | None = None, strict: bool = False) -> DataFrame:
    """``n`` pixels without replacement, of those with mask 1; with ``strict``, fewer raise."""
    valid = pixels if mask is None else pixels.filter(F.col(mask) == 1)
    if strict and valid.limit(n).count() < n:
        raise ValueError(f"fewer than {n} pixels")
    return valid.orderBy(hash_order(key) if order is None else order, F.col(key)).limit(n)


def quotas(per_tile: DataFrame, wanted: int, up: bool = False, carried: str | None = None) -> DataFrame:
    """``per_tile`` (a row a tile with ``n``) with ``quota``: its share of ``wanted``, rounded (up).

    With ``carried``, the tile's column, what rounding leaves goes on to the next tile, so that all have ``wanted`` together, however many they are.
    """
    ratio = F.lit(float(wanted)) / F.sum("n").over(Window.partitionBy(F.lit(0)))
    share = F.col("n") * F.least(F.lit(1.0), ratio)
    if carried is None:
        return per_tile.withColumn("quota", (F.ceil(share) if up else F.round(share)).cast("bigint"))
    # Sums of whole numbers, which don't hang on their order.
    upto = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(carried).rowsBetween(Window.unboundedPreceding, 0))
    place = lambda n: F.round(n * F.least(F.lit(1.0), ratio))
    return per_tile.withColumn("quota", (place(upto) - place(upto - F.col("n"))).cast("bigint"))


def in_ranges(rows: DataFrame, keys: Sequence[str], order: str, weight: Column) -> DataFrame:
    """``rows`` with ``_part``, the range of ``order`` (a number) that each is in, ``_before``, the sum of ``weight`` over the ranges before, and ``_rows``, of each group by ``keys``.

    Ranges are cut at quantiles of a sketch, so they are even however the order is spread, and no task sorts a group whole. Cuts and
    sizes are broadcast as long as groups are few.
    """
    keys, own = list(keys), F.col(order).cast("double")
    n_ranges = STEPS * STEPS
    levels = [i / n_ranges for i in range(1, n_ranges)]
    whole = small(rows.groupBy(*keys).agg(F.percentile_approx(own, levels).alias("_cuts"), F.count(F.lit(1)).alias("_rows")), MAX_TILES)
    above = lambda cuts: F.size(F.filter(cuts, lambda x: x < own))
    # The range in two steps: which of the coarse cuts, then which of those between.
    coarse = above(F.transform(F.sequence(F.lit(1), F.lit(STEPS - 1)), lambda i: F.element_at("_cuts", i * STEPS)))
    cut = rows.join(whole, keys).withColumn("_coarse", coarse)
    cut = cut.withColumn("_part", F.col("_coarse") * STEPS + above(F.slice("_cuts", F.col("_coarse") * STEPS + 1, F.lit(STEPS - 1)))).drop("_coarse", "_cuts")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(*keys, "_part").agg(F.sum(weight).alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    return cut.join(small(sizes, MAX_TILES * STEPS), [*keys, "_part"])


def ranked(rows: DataFrame, tile: str, order: Column, key: str) -> DataFrame:
    """``rows`` with ``_i``, the rank in its tile by ``order`` (a number) and ``key`` (from 1), and ``_n``, the tile's rows."""
    placed = in_ranges(rows.withColumn("_o", order), [tile], "_o", F.lit(1)).withColumnRenamed("_rows", "_n")
    place = F.row_number().over(Window.partitionBy(tile, "_part").orderBy("_o", key))
    return placed.withColumn("_i", F.col("_before") + place).drop("_o", "_part", "_before")


def sample_tiles(pixels: DataFrame, tile: str, wanted: int, key: str, regular: bool = True, order: Column | None = None, carried: bool = False) -> DataFrame:
    """Pixels of every tile in proportion to its size: evenly spaced by ``key``, or in hash order. ``carried``: as in ``quotas``."""
    counts = pixels.groupBy(tile).agg(F.count(F.lit(1)).alias("n"))
    own = F.col(key) if regular else (hash_order(key) if order is None else order)
    placed = ranked(pixels, tile, own, key).join(small(quotas(counts, wanted, carried=tile if carried else None)), tile)
    step = lambda i: F.floor(i * F.col("quota") / F.col("n"))
    picked = (step(F.col("_i")) > step(F.col("_i") - 1)) if regular else F.col("_i") <= F.col("quota")
    return placed.filter(picked).drop("_i", "_n", "n", "quota")


def sample_fraction(pixels: DataFrame, tile: str, share: float, key: str, order: Column | None = None) -> DataFrame:
    """The first ``share`` of each tile in the draw's order, at least one pixel."""
    placed = ranked(pixels, tile, hash_order(key) if order is None else order, key)
    return placed.filter(F.col("_i") <= F.greatest(F.lit(1), F.floor(F.col("_n") * share))).drop("_i", "_n")


def around(centres: DataFrame, pixels: DataFrame, width: int, row: str = "r", col: str = "c", keys: Sequence[str] = ()) -> DataFrame:
    """Pixels of the square plots of ``width`` around ``centres`` (``plot_id``, row, col): offsets, then an equi-join."""
    low, high = -(width // 2), (width - 1) // 2
    steps = F.sequence(F.lit(low), F.lit(high))
    down = centres.select(*keys, "plot_id", row, col, F.explode(steps).alias("_down"))
    spread = down.select(*keys, "plot_id", row, col, "_down", F.explode(steps).alias("_across"))
    cells = spread.select(*keys, "plot_id", (F.col(row) + F.col("_down")).alias(row), (F.col(col) + F.col("_across")).alias(col))
    return cells.join(pixels, [*keys, row, col])


@dataclass(frozen=True)
class Geographic:
    """A grid in degrees: the latitude and longitude of the centre of pixel (0, 0), and what a row and a column add."""

    latitude: float
    longitude: float
    row_step: float
    col_step: float

    def at(self, row: Column, col: Column) -> tuple[Column, Column]:
        return F.lit(self.latitude) + row * self.row_step, F.lit(self.longitude) + col * self.col_step


def around_metres(centres: DataFrame, pixels: DataFrame, metres: float, grid: Geographic, row: str = "r", col: str = "c") -> DataFrame:
    """Pixels of the plots of ``metres`` by ``metres`` of ground around ``centres`` (``plot_id``, row, col) of a grid in degrees.

    A plot's rows follow its centre's latitude, its columns that of each of its rows: parallels are shorter towards the poles. A pixel belongs to it
    if its centre lies within half of ``metres``. Plots meet pixels by row and column, an equi-join; a plot has no more cells than the
    extent of the pixels, and where a parallel has no length (at a pole and beyond it) it has the whole row.
    """
    box = extent(pixels, row, col).first()  # one row
    half, far = F.lit(metres / 2), F.lit(float(1 << 53))
    # Nothing where the plot lies beside the extent.
    between = lambda low, high: F.explode(F.when(low <= high, F.sequence(low, high)))
    latitude, _ = grid.at(F.col(row), F.col(col))
    down = F.floor(F.least(half / (degree_of_latitude(latitude) * abs(grid.row_step)), far)).cast("bigint")
    top, bottom = F.greatest(F.col(row) - down, F.lit(box.r_min).cast("bigint")), F.least(F.col(row) + down, F.lit(box.r_max).cast("bigint"))
    rows = centres.select("plot_id", F.col(col).alias("_c"), between(top, bottom).alias(row))
    latitude, _ = grid.at(F.col(row), F.col("_c"))
    ground = degree_of_longitude(latitude) * abs(grid.col_step)
    across = F.floor(F.when(ground > 0, F.least(half / F.when(ground > 0, ground), far)).otherwise(far)).cast("bigint")
    left, right = F.greatest(F.col("_c") - across, F.lit(box.c_min).cast("bigint")), F.least(F.col("_c") + across, F.lit(box.c_max).cast("bigint"))
    cells = rows.select("plot_id", row, between(left, right).alias(col))
    return cells.join(pixels, [row, col])


def sample_plots(pixels: DataFrame, n: int, key: str, width: int, least: float, order: Column | None = None, strict: bool = False, mask: str | None = None) -> DataFrame:
    """Pixels of ``n`` square plots around sampled centres that have at least (``strict``: more than) ``least`` of their area."""
    valid = pixels if mask is None else pixels.filter(F.col(mask) == 1)
    centres = sample_pixels(valid, n, key, order).select(F.col(key).alias("plot_id"), "r", "c")
    own = around(centres, valid, width)
    counts = own.groupBy("plot_id").agg(F.count(F.lit(1)).alias("_n"))
    bound = least * width * width
    return own.join(counts.filter(F.col("_n") > bound if strict else F.col("_n") >= bound).select("plot_id"), "plot_id", "left_semi")


def sample_tile_plots(pixels: DataFrame, tile: str, per_tile: int | DataFrame, key: str, width: int, least: float = 0.6, spare: int = 5, order: Column | None = None) -> DataFrame:
    """Pixels of plots in each tile: ``spare`` more centres than wanted, those with more than ``least`` of their area, the first ``per_tile`` of them, numbered over all tiles.

    ``per_tile`` is a number or a table (``tile``, ``quota``).
    """
    own_order = ranked(pixels, tile, hash_order(key) if order is None else order, key).drop("_n")
    placed = own_order.withColumn("quota", F.lit(per_tile)) if isinstance(per_tile, int) else own_order.join(small(per_tile.select(tile, "quota")), tile)
    centres = placed.filter(F.col("_i") <= F.col("quota") + spare).select(F.col("_i").alias("plot_id"), "r", "c", tile, "quota")
    own = around(centres.drop("quota"), pixels.withColumnRenamed(key, "_key"), width, keys=[tile]).withColumnRenamed("_key", key)
    good = own.groupBy(tile, "plot_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > least * width * width)
    kept = good.withColumn("_j", F.row_number().over(Window.partitionBy(tile).orderBy("plot_id"))).join(centres.select(tile, "plot_id", "quota"), [tile, "plot_id"]).filter(F.col("_j") <= F.col("quota"))
    # A row a plot, and plots are as many as the sample wants.
    numbered = kept.withColumn("plot", F.dense_rank().over(Window.orderBy(tile, "plot_id"))).select(tile, "plot_id", "plot")
    return own.join(numbered, [tile, "plot_id"]).drop("plot_id").withColumnRenamed("plot", "plot_id")


def sample_all_tiles(pixels: DataFrame, tile: str, key: str, n_pixels: int, n_plots: int, width: int, order: Column | None = None, carried: bool = False) -> tuple[DataFrame, DataFrame]:
    """Pixels for the species and pixels of plots (``plot_id``) for the ordination, of every tile in proportion to its pixels.

    Pixels are evenly spaced, quotas of plots are rounded up; those of pixels are rounded, and with more than two tiles a pixel wanted none is left, unless they are ``carried``.
    """
    counts = pixels.groupBy(tile).agg(F.count(F.lit(1)).alias("n"))
    return sample_tiles(pixels, tile, n_pixels, key, carried=carried), sample_tile_plots(pixels, tile, quotas(counts, n_plots, up=True), key, width, order=order)


def cells_at(pixels: DataFrame, coordinates: DataFrame, mask: str | None = None, row: str = "r", col: str = "c") -> DataFrame:
    """The pixels at given cells, with mask 1."""
    valid = pixels if mask is None else pixels.filter(F.col(mask) == 1)
    return coordinates.join(valid, [row, col])


def values_in_plots(pixels: DataFrame, plot: str, value: str) -> DataFrame:
    """``plot``, ``values``: the sorted values of each plot."""
    return pixels.groupBy(plot).agg(F.array_sort(F.collect_list(value)).alias("values"))
