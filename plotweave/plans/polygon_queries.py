"""Queries over polygons of several parts with holes."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotweave.functions.geodesy import FLATTENING, HALF_AXIS
from plotweave.operators import plots, polygons, sampling, windows
from plotweave.plans.bindings import BANDS, PIXELS_SQL, pixels, rounded, table

#: Rings of points (x, y); holes run the other way round.
POLYGONS = {
    1: [[(2.5, 1.25), (40.5, 1.25), (40.5, 30.5), (2.5, 30.5)], [(10.0, 3.0), (10.0, 20.0), (25.5, 20.0), (25.5, 3.0)], [(50.0, 2.0), (70.0, 2.0), (60.0, 25.75)]],
    2: [[(5.0, 0.5), (95.3, 4.25), (80.5, 60.0), (60.1, 20.3), (30.0, 8.0)]],
    3: [[(0.0, 0.0), (99.0, 0.0), (99.0, 99.0), (50.5, 40.25), (0.0, 99.0)], [(20.0, 10.0), (20.0, 30.0), (30.0, 10.0)]],
}
CELL, POINTS = 15, 200
RING_KIND = "plot_id bigint, rings array<array<struct<x:double,y:double>>>"


def _polygons(spark):
    return spark.createDataFrame(list(POLYGONS.items()), RING_KIND)


def extract_polygons(spark, sf_dir):
    """Pixels of polygons, found by scan lines, masked and counted."""
    px = pixels(spark, sf_dir).withColumn("mask", (F.col("k") > 30).cast("int"))
    own = plots.extract(px, _polygons(spark), BANDS, "mask", 0.6, rings="rings")
    return rounded(own.groupBy("plot_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value")))


def grid_clipped(spark, sf_dir):
    """Grid cells that an area of interest touches, with the share that it covers."""
    found = polygons.clipped_grid(windows.grid(pixels(spark, sf_dir), CELL), _polygons(spark), CELL)
    return rounded(found.select("plot_id", "cell_r", "cell_c", "n", "share"))


def points_in_polygons(spark, sf_dir):
    """Random points in a polygon of each nation: how many there are, lie inside, and differ."""
    k, size = F.col("n_nationkey") * 10.0, F.col("n_regionkey") + 4.0
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = lambda *p: F.array(*(point(k + F.lit(x) * size / 8, F.lit(y) * size / 8) for x, y in p))
    shapes = F.array(ring((0, 0), (8, 1), (8, 8), (0, 8)), ring((2, 2), (2, 6), (5, 5)), ring((9, 0), (9.5, 4), (9.75, 0.5)))
    own = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("plot_id"), shapes.alias("rings"))
    drawn = polygons.random_points(own, POINTS, 3)
    over = (F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))
    at = F.col("x1") + (F.col("y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    # Few polygons, so each point meets the edges of its own.
    crossings = drawn.join(polygons.edges(own), "plot_id").groupBy("plot_id", "number", "x", "y").agg(F.count(F.when(over & (F.col("x") < at), 1)).alias("n"))
    return crossings.groupBy("plot_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("n") % 2 == 1, 1)).alias("inside"), F.count_distinct("x", "y").alias("places"))


#: A grid of a hundredth of a degree, from a latitude near the pole to the south.
GRID, METRES = sampling.Geographic(72.0, 10.0, -0.05, 0.02), 12_000.0


def metric_plots(spark, sf_dir):
    """Plots of equal ground on events as a grid in degrees: they get narrower in columns to the south."""
    px = pixels(spark, sf_dir)
    centres = px.filter("event_id % 97 = 5").select(F.col("event_id").alias("plot_id"), "r", "c")
    own = sampling.around_metres(centres, px, METRES, GRID)
    width = F.max("c") - F.min("c") + 1
    return rounded(own.groupBy("plot_id").agg(F.count(F.lit(1)).alias("n"), width.alias("width"), (F.max("r") - F.min("r") + 1).alias("height"), F.avg("value").alias("mean_value")))


QUERIES = {f.__name__: f for f in (extract_polygons, grid_clipped, points_in_polygons, metric_plots)}

_EDGES = ", ".join(f"({plot}, {x1}::double, {y1}::double, {x2}::double, {y2}::double)" for plot, rings in POLYGONS.items() for ring in rings for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True))
_ED = f"ed(plot_id, x1, y1, x2, y2) as (values {_EDGES})"

_LAT = lambda r: f"({GRID.latitude} + {r} * ({GRID.row_step}))::double"
_SIN = lambda r: f"sin(radians({_LAT(r)}))"
_E2 = f"({FLATTENING!r}::double * (2 - {FLATTENING!r}::double))"
_OF_LAT = lambda r: f"(pi() / 180 * {HALF_AXIS} * (1 - {_E2}) / pow(1 - {_E2} * pow({_SIN(r)}, 2), 1.5))"
_OF_LON = lambda r: f"(pi() / 180 * {HALF_AXIS} * cos(radians({_LAT(r)})) / sqrt(1 - {_E2} * pow({_SIN(r)}, 2)))"

ORACLE_SQL = {
    # By distances along meridian and parallel, with no floor.
    "metric_plots": f"""with {PIXELS_SQL} select a.event_id as plot_id, count(*) as n, max(b.c) - min(b.c) + 1 as width, max(b.r) - min(b.r) + 1 as height, round(avg(b.value), 6) as mean_value
 from px as a join px as b on b.r between a.r - 5 and a.r + 5 and abs(b.r - a.r) * {abs(GRID.row_step)} * {_OF_LAT('a.r')} <= {METRES / 2} and abs(b.c - a.c) * {GRID.col_step} * {_OF_LON('b.r')} <= {METRES / 2}
 where a.event_id % 97 = 5 group by 1""",
    # Even-odd, every pixel against every edge.
    "extract_polygons": f"""with {PIXELS_SQL}, {_ED}, i as (select plot_id, event_id, any_value(value) as value, any_value(k) as k from px, ed where (y1 > r) <> (y2 > r) and c < x1 + (r - y1) * (x2 - x1) / (y2 - y1) group by plot_id, event_id having count(*) % 2 = 1)
 select plot_id::bigint as plot_id, count(*) filter (k > 30) as n, round(avg(value) filter (k > 30), 6) as mean_value from i group by 1 having count(*) filter (k > 30) >= 0.6 * count(*)""",
    # The area under each edge within a cell, signed by the edge's direction.
    "grid_clipped": f"""with {PIXELS_SQL}, {_ED}, g as (select r // {CELL} as cell_r, c // {CELL} as cell_c, count(*) as n from px group by 1, 2),
 a as (select *, greatest(least(x1, x2), cell_c * {CELL}::double) as a, least(greatest(x1, x2), (cell_c + 1) * {CELL}::double) as b from g, ed where x1 <> x2),
 t as (select *, y1 + (a - x1) * (y2 - y1) / (x2 - x1) - cell_r * {CELL}::double as ta, y1 + (b - x1) * (y2 - y1) / (x2 - x1) - cell_r * {CELL}::double as tb from a where a < b),
 u as (select *, case when ta < 0 then 0 when ta > {CELL} then {CELL} * ta - {CELL * CELL / 2} else ta * ta / 2 end as ga, case when tb < 0 then 0 when tb > {CELL} then {CELL} * tb - {CELL * CELL / 2} else tb * tb / 2 end as gb from t),
 s as (select plot_id, cell_r, cell_c, any_value(n) as n, abs(sum(sign(x2 - x1) * (b - a) * case when abs(tb - ta) < 1e-9 then least({CELL}, greatest(0, ta)) else (gb - ga) / (tb - ta) end)) / {CELL * CELL} as share from u group by 1, 2, 3)
 select plot_id::bigint as plot_id, cell_r, cell_c, n, round(share, 6) as share from s where share > 1e-9""",
    "points_in_polygons": f"select n_nationkey::bigint as plot_id, {POINTS}::bigint as n, {POINTS}::bigint as inside, {POINTS}::bigint as places from nation",
}
