"""Polygons of several parts with holes, over a grid: the pixels inside, the cells that they cover, and random points in them.

A polygon is an array of rings, a ring an array of points (``x`` is the column, ``y`` the row), closed or not. By the even-odd rule
parts and holes need no names; where areas matter, holes run the other way round than parts, as is usual in vector files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a cell by which intervals of columns meet pixels.
SPAN = 64
RINGS = "array<array<struct<x:double,y:double>>>"


def edges(polygons: DataFrame) -> DataFrame:
    """``plot_id``, ``x1 y1 x2 y2``: the edges of all rings; the last point joins the first."""
    rings = polygons.select("plot_id", F.posexplode("rings").alias("_ring", "ring"))
    points = rings.select("plot_id", "ring", F.posexplode("ring").alias("_i", "p"))
    following = F.get("ring", (F.col("_i") + 1) % F.size("ring"))
    return points.select("plot_id", F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), following["x"].alias("x2"), following["y"].alias("y2"))


def intervals(polygons: DataFrame) -> DataFrame:
    """``plot_id``, ``r``, ``c0``, ``c1``: the columns inside, line by line.

    Every edge crosses the lines from its lower end up to, but without, its upper one. Sorted, the crossings of a line open and
    close the inside in turn. A list holds the crossings of one line, two for each time that the outline passes it.
    """
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    over = edges(polygons).filter(F.ceil(low) < F.ceil(high))
    lines = over.select("plot_id", "x1", "y1", "x2", "y2", F.explode(F.sequence(F.ceil(low), F.ceil(high) - 1)).alias("r"))
    at = F.col("x1") + (F.col("r") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    crossings = lines.select("plot_id", "r", at.alias("x")).groupBy("plot_id", "r").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    pair = F.sequence(F.lit(1), (F.size("xs") / 2).cast("int"))
    ends = F.transform(pair, lambda k: F.struct(F.ceil(F.element_at("xs", 2 * k - 1)).alias("c0"), (F.ceil(F.element_at("xs", 2 * k)) - 1).alias("c1")))
    return crossings.select("plot_id", "r", F.explode(ends).alias("x")).select("plot_id", "r", "x.*").filter("c0 <= c1")


def pixels_inside(pixels: DataFrame, polygons: DataFrame, span: int = SPAN) -> DataFrame:
    """``pixels`` with the ``plot_id`` of each polygon they lie in; a pixel on a left or upper edge is inside, on a right or lower one outside.

    Intervals meet pixels by line and cell of ``span`` columns, an equi-join; no pixel is tested against the points of a polygon.
    """
    spread = F.explode(F.sequence(F.floor(F.col("c0") / span), F.floor(F.col("c1") / span)))
    spans = intervals(polygons).select("plot_id", F.col("r").alias("_r"), "c0", "c1", spread.alias("_span"))
    met = pixels.withColumn("_own", F.floor(F.col("c") / span)).join(spans, (F.col("r") == F.col("_r")) & (F.col("_own") == F.col("_span")))
    return met.filter(F.col("c").between(F.col("c0"), F.col("c1"))).drop("_own", "_span", "_r", "c0", "c1")


def _cut(ring: Column, side: str, at: Column, keep_above: bool) -> Column:
    """A ring without what lies beyond a line ``side = at`` (Sutherland and Hodgman 1974)."""
    other = "y" if side == "x" else "x"

    def edge(p: Column, i: Column) -> Column:
        q = F.get(ring, (i + 1) % F.size(ring))
        inside = lambda a: (a[side] >= at) if keep_above else (a[side] <= at)
        share = F.try_divide(at - p[side], q[side] - p[side])
        along = p[other] + share * (q[other] - p[other])
        crossing = F.struct(at.alias("x"), along.alias("y")) if side == "x" else F.struct(along.alias("x"), at.alias("y"))
        here = F.struct(p["x"].alias("x"), p["y"].alias("y"))
        return F.concat(F.when(inside(p), F.array(here)).otherwise(F.expr("array()").cast("array<struct<x:double,y:double>>")), F.when(inside(p) != inside(q), F.array(crossing)).otherwise(F.expr("array()").cast("array<struct<x:double,y:double>>")))

    return F.flatten(F.transform(ring, edge))


def signed_area(ring: Column) -> Column:
    """Area by the shoelace formula, of either sign by the ring's direction; about its first point, so that far rings keep their digits."""
    x0, y0 = F.get(ring, F.lit(0))["x"], F.get(ring, F.lit(0))["y"]

    def part(p: Column, i: Column) -> Column:
        q = F.get(ring, (i + 1) % F.size(ring))
        return ((p["x"] - x0) * (q["y"] - y0) - (q["x"] - x0) * (p["y"] - y0)) / 2

    return F.aggregate(F.transform(ring, part), F.lit(0.0), lambda a, b: a + b)


def covered_cells(areas: DataFrame, cell: float, top: float = 0.0, left: float = 0.0) -> DataFrame:
    """``plot_id``, ``cell_r``, ``cell_c``, ``share``: the square cells that an area covers in part, and which part of each.

    Rings are cut to bands of cells first and then to cells, so that a cell only sees the points in its band. Shares of an area add up to it.
    """
    rings = areas.select("plot_id", F.posexplode("rings").alias("_ring", "ring")).filter(F.size("ring") > 2)
    reach = lambda side, start: F.explode(F.sequence(F.floor((F.array_min(F.transform("ring", lambda p: p[side])) - start) / cell), F.floor((F.array_max(F.transform("ring", lambda p: p[side])) - start) / cell)))
    bands = rings.select("plot_id", "_ring", "ring", reach("y", top).alias("cell_r"))
    y0 = F.col("cell_r") * cell + top
    bands = bands.withColumn("ring", _cut(F.col("ring"), "y", y0, True)).withColumn("ring", _cut(F.col("ring"), "y", y0 + cell, False)).filter(F.size("ring") > 2)
    cells = bands.select("plot_id", "_ring", "ring", "cell_r", reach("x", left).alias("cell_c"))
    x0 = F.col("cell_c") * cell + left
    cells = cells.withColumn("ring", _cut(F.col("ring"), "x", x0, True)).withColumn("ring", _cut(F.col("ring"), "x", x0 + cell, False)).filter(F.size("ring") > 2)
    summed = cells.groupBy("plot_id", "cell_r", "cell_c").agg(F.sum(signed_area(F.col("ring"))).alias("_area"))
    return summed.select("plot_id", "cell_r", "cell_c", (F.abs("_area") / (cell * cell)).alias("share")).filter("share > 1e-12")


def clipped_grid(cells: DataFrame, areas: DataFrame, cell: float, top: float = 0.0, left: float = 0.0) -> DataFrame:
    """A grid's cells (``cell_r``, ``cell_c``) that an area of interest touches, with their covered ``share`` by area."""
    return cells.join(covered_cells(areas, cell, top, left), ["cell_r", "cell_c"])


def random_points(polygons: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``plot_id``, ``number`` (from 0), ``x``, ``y``: ``n`` points spread evenly over each polygon.

    Nothing is drawn and rejected: the plane's strip under each edge is a trapezoid, and a polygon is what the trapezoids of its scan bands
    leave. Bands lie between neighbouring heights of the polygon's points; within one, sorted edges open and close trapezoids in turn.
    A hash of seed, polygon and number chooses a trapezoid by its area, two more the place in it, so a point doesn't depend on how rows are
    partitioned. A list holds the trapezoids of one polygon, as many as its points times its edges across a band.
    """
    all_edges = edges(polygons).filter("y1 <> y2")
    upward = F.col("y1") < F.col("y2")
    pick = lambda a, b: F.when(upward, F.col(a)).otherwise(F.col(b))
    up = all_edges.select("plot_id", pick("x1", "x2").alias("xa"), F.least("y1", "y2").alias("ya"), pick("x2", "x1").alias("xb"), F.greatest("y1", "y2").alias("yb"))
    heights = up.select("plot_id", F.explode(F.array("ya", "yb")).alias("y")).groupBy("plot_id").agg(F.array_sort(F.collect_set("y")).alias("ys"))
    low_high = F.transform(F.sequence(F.lit(1), F.size("ys") - 1), lambda k: F.struct(F.element_at("ys", k).alias("low"), F.element_at("ys", k + 1).alias("high")))
    inside = up.join(heights, "plot_id").select("plot_id", "xa", "ya", "xb", "yb", F.explode(F.filter(low_high, lambda b: (b["low"] >= F.col("ya")) & (b["high"] <= F.col("yb")))).alias("b"))
    at = lambda y: F.col("xa") + (y - F.col("ya")) * (F.col("xb") - F.col("xa")) / (F.col("yb") - F.col("ya"))
    sides = inside.select("plot_id", "b.low", "b.high", at(F.col("b.low")).alias("x_low"), at(F.col("b.high")).alias("x_high"))
    side = F.struct(((F.col("x_low") + F.col("x_high")) / 2).alias("m"), "x_low", "x_high")
    bands = sides.groupBy("plot_id", "low", "high").agg(F.array_sort(F.collect_list(side)).alias("s"))
    pairs = F.transform(F.sequence(F.lit(1), (F.size("s") / 2).cast("int")), lambda k: F.struct(F.element_at("s", 2 * k - 1).alias("a"), F.element_at("s", 2 * k).alias("b")))
    shapes = bands.select("plot_id", "low", "high", F.explode(pairs).alias("p"))
    width = lambda k: F.col(f"p.b.x_{k}") - F.col(f"p.a.x_{k}")
    area = (width("low") + width("high")) / 2 * (F.col("high") - F.col("low"))
    shape = F.struct("low", "high", F.col("p.a.x_low").alias("al"), F.col("p.a.x_high").alias("ah"), F.col("p.b.x_low").alias("bl"), F.col("p.b.x_high").alias("bh"), area.alias("area"))
    listed = shapes.filter(area > 0).groupBy("plot_id").agg(F.array_sort(F.collect_list(shape)).alias("t"))
    upto = F.transform(F.sequence(F.lit(1), F.size("t")), lambda k: F.aggregate(F.slice("t", 1, k), F.lit(0.0), lambda a, x: a + x["area"]))
    drawn = listed.withColumn("upto", upto).withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    uniform = lambda k: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(k), "plot_id", "number"), 11).cast("double") / float(1 << 53))
    place = F.array_position(F.transform("upto", lambda u: u > uniform(0) * F.element_at("upto", -1)), True).cast("int")
    chosen = drawn.select("plot_id", "number", F.element_at("t", place).alias("z"))
    low_width, high_width = F.col("z.bl") - F.col("z.al"), F.col("z.bh") - F.col("z.ah")
    # Of a trapezoid's height, in proportion to its width there.
    u = uniform(1)
    root = F.sqrt(low_width * low_width * (1 - u) + high_width * high_width * u)
    up_share = F.when(F.abs(high_width - low_width) <= 1e-12 * (high_width + low_width), u).otherwise((root - low_width) / (high_width - low_width))
    x_left = F.col("z.al") + up_share * (F.col("z.ah") - F.col("z.al"))
    across = low_width + up_share * (high_width - low_width)
    return chosen.select("plot_id", "number", (x_left + uniform(2) * across).alias("x"), (F.col("z.low") + up_share * (F.col("z.high") - F.col("z.low"))).alias("y"))
