"""Field plots: pixels inside polygons, and their attributes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.operators.masks import clean
from plotweave.operators.polygons import pixels_inside
from plotweave.operators.sampling import ranked

#: Side of the cells that pair plots with pixels before the exact test.
CELL = 16


def numbered(layers: Sequence[tuple[str, DataFrame]], local: str = "local_id") -> DataFrame:
    """Layers of plots in one frame, with ``source`` and ``plot_id``: numbers, in the order of ``local`` (a number), go on from one layer to the next."""
    tagged = [frame.withColumn("source", F.lit(name)).withColumn("_layer", F.lit(i)) for i, (name, frame) in enumerate(layers)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    sizes = F.create_map(*(x for i, (_, frame) in enumerate(layers) for x in (F.lit(i), F.lit(frame.count()))))
    # Ranks in a layer go on from the sizes of the layers before it; no task numbers a layer whole.
    earlier = [F.coalesce(F.when(F.col("_layer") > i, sizes[i]), F.lit(0)) for i in range(len(layers))]
    return ranked(rows, "_layer", F.col(local), local).withColumn("plot_id", (F.col("_i") + reduce(lambda a, b: a + b, earlier)).cast("bigint")).drop("_layer", "_i", "_n")


def covered(plots: DataFrame, cell: int = CELL) -> DataFrame:
    """``plots`` once for each grid cell that their box (``r0 r1 c0 c1``) touches."""
    spread = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell)))
    return plots.withColumn("_gr", spread("r0", "r1")).withColumn("_gc", spread("c0", "c1"))


def inside_box() -> Column:
    return F.col("r").between(F.col("r0"), F.col("r1")) & F.col("c").between(F.col("c0"), F.col("c1"))


def extract(pixels: DataFrame, plots: DataFrame, bands: Sequence[str], mask: str | None = None, least: float = 0.25, cell: int = CELL, rings: str | None = None) -> DataFrame:
    """``plot_id`` and the pixels inside each plot; plots keep at least ``least`` of their pixels after mask and cleaning.

    A plot is its box ``r0 r1 c0 c1``, or with ``rings`` a polygon (``polygons``). Boxes meet pixels by grid cell, an equi-join that scales with
    both, then by the exact test; polygons by their scan lines.
    """
    if rings:
        own = pixels_inside(pixels, plots.select("plot_id", F.col(rings).alias("rings")))
    else:
        keyed = pixels.withColumn("_gr", F.floor(F.col("r") / cell)).withColumn("_gc", F.floor(F.col("c") / cell))
        columns = ["plot_id", "r0", "r1", "c0", "c1"]
        own = keyed.join(covered(plots.select(*columns), cell), ["_gr", "_gc"]).filter(inside_box()).drop("_gr", "_gc", *columns[1:])
    before = own.groupBy("plot_id").agg(F.count(F.lit(1)).alias("_all"))
    valid = clean(own if mask is None else own.filter(F.col(mask) == 1), bands)
    after = valid.groupBy("plot_id").agg(F.count(F.lit(1)).alias("_kept"))
    good = before.join(after, "plot_id").filter(F.col("_kept") >= least * F.col("_all")).select("plot_id")
    return valid.join(good, "plot_id", "left_semi")


def with_attributes(plots: DataFrame, results: DataFrame, key: str = "plot_id") -> DataFrame:
    """All plots with their results, null where there is none."""
    return plots.join(results, key, "left")
