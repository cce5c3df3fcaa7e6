"""Plots in metres where parallels have no length."""

import pytest
from pyspark.sql import functions as F

from plotweave.functions import geodesy
from plotweave.operators import sampling


@pytest.mark.parametrize("first", [-89.0, -89.9, 88.0])
def test_plots_at_the_poles(spark, first):
    """Rows that end at a pole, and go on beyond it."""
    grid = sampling.Geographic(first, 10.0, -0.05 if first < 0 else 0.05, 0.02)
    px = spark.range(80 * 7).select((F.col("id") / 7).cast("bigint").alias("r"), (F.col("id") % 7).alias("c"))
    centres = px.filter("(r * 7 + c) % 17 = 3").select((F.col("r") * 7 + F.col("c")).alias("plot_id"), "r", "c")
    found = {tuple(x) for x in sampling.around_metres(centres, px, 12_000.0, grid).select("plot_id", "r", "c").collect()}
    rows = px.select("r", *(f(grid.at(F.col("r"), F.col("c"))[0]).alias(n) for n, f in (("ns", geodesy.degree_of_latitude), ("ew", geodesy.degree_of_longitude)))).distinct().collect()
    ns, ew = {x.r: x.ns for x in rows}, {x.r: x.ew for x in rows}
    near = lambda a, b, r, c: abs(b - r) * 0.05 * ns[r] <= 6000 and abs(a - c) * 0.02 * ew[b] <= 6000
    assert found == {(x.plot_id, b, a) for x in centres.collect() for b in range(80) for a in range(7) if near(a, b, x.r, x.c)}
    assert any(v <= 0 for v in ew.values())


def test_a_centre_beside_the_extent(spark):
    px = spark.createDataFrame([(5, 5)], "r bigint, c bigint")
    centres = spark.createDataFrame([(1, 100, 5), (2, 5, 90), (3, 5, 4)], "plot_id bigint, r bigint, c bigint")
    grid = sampling.Geographic(10.0, 0.0, -0.05, 0.02)
    assert [x.plot_id for x in sampling.around_metres(centres, px, 12_000.0, grid).collect()] == [3]
    assert sampling.around_metres(centres, px.filter("r > 9"), 12_000.0, grid).collect() == []
