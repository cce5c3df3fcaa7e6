"""Queries that write events as rasters and read them again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from plotweave.operators import sensors
from plotweave.operators.transforms import INDICES
from plotweave.plans.bindings import BANDS, PIXELS_SQL, TILE_ROWS, pixels, rounded
from plotweave.sources import headers, maps, rasters
from plotweave.sources.shared import fresh_path

LINES = 7, 41
#: Lines that a tile of the overlapping mosaic shares with its neighbours on each side.
MARGIN = 3


def raster_interleaves(spark, sf_dir):
    """Two bands and some lines of the three interleaves."""
    found = []
    for interleave in rasters.INTERLEAVES:
        path = fresh_path(spark, f"raster-{interleave}")
        rasters.write_mosaic(pixels(spark, sf_dir), path, BANDS, interleave=interleave)
        found.append(rasters.read_raster(spark, path, ["k", "value"], LINES).withColumn("interleave", F.lit(interleave)))
    return reduce(lambda a, b: a.unionByName(b), found).select("interleave", "r", "c", "value", "k")


def raster_header(spark, sf_dir):
    """What the headers of the tiles say."""
    path = fresh_path(spark, "raster-headers")
    rasters.write_mosaic(pixels(spark, sf_dir), path, BANDS)
    found = headers.read_headers(spark, f"{path}/*.hdr").groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("value", F.size("numbers").alias("n"))))).alias("m"))
    number = lambda k: F.col("m")[k]["value"].cast("bigint").alias(k.replace(" ", "_"))
    return found.select(number("y start"), number("x start"), number("lines"), number("samples"), number("bands"), F.col("m")["interleave"]["value"].alias("interleave"), F.col("m")["band names"]["value"].alias("band_names"), F.col("m")["lines"]["n"].cast("bigint").alias("n_lines"))


def _overlapping(spark, sf_dir):
    """Tiles with ``MARGIN`` lines of their neighbours, a fourth of their values missing."""
    px = pixels(spark, sf_dir)
    around = px.withColumn("t", F.explode(F.sequence(F.floor((F.col("r") - MARGIN) / TILE_ROWS), F.floor((F.col("r") + MARGIN) / TILE_ROWS)))).filter("t >= 0")
    there = F.when((F.col("event_id") + F.col("t")) % 4 != 0, F.col("value") + 1000 * F.col("t"))
    return around.select(F.col("t").alias("tile"), "r", "c", there.alias("value"))


def mosaic_overlap(spark, sf_dir):
    """The first valid value where tiles overlap, read from the index of a mosaic."""
    path = fresh_path(spark, "mosaic")
    rasters.write_mosaic(_overlapping(spark, sf_dir), path, ["value"])
    return rasters.read_raster(spark, path)


def written_map(spark, sf_dir):
    """A map written a folder a tile, one tile written again, read back by rows, and its layers side by side again."""
    path = fresh_path(spark, "map")
    px = pixels(spark, sf_dir).select("tile", "r", "c", "value", "k")
    maps.write_map(px, path, "tile")
    maps.write_map(px.filter("tile = 1").withColumn("k", F.lit(-1.0)), path, "tile")
    layers = maps.long_map(maps.read_pixels(spark, path, ["tile", "value", "k"], LINES), ["tile", "r", "c"], ["value", "k"])
    return maps.wide_map(layers, ["tile", "r", "c"], ["value", "k"]).select(F.col("tile").cast("bigint").alias("tile"), "r", "c", "value", "k")


N_REFLECTANCES = 10


def _reflectances(spark, sf_dir):
    """Reflectances of ten bands, made of events."""
    e = F.col("event_id")
    return pixels(spark, sf_dir).select("event_id", "tile", "r", "c", *((F.pmod(e * (7 + 2 * i) + F.col("minute"), F.lit(4000)) + 1).cast("double").alias(f"band_{i}") for i in range(N_REFLECTANCES)))


def index_tiles(spark, sf_dir):
    """Indices of reflectances by tile: bands named, a mask of cells of 5 by 5, thresholds; stored as a mosaic, read again."""
    px = _reflectances(spark, sf_dir)
    mask = px.select((F.floor(F.col("r") / 5)).alias("r"), F.floor(F.col("c") / 5).alias("c")).distinct().withColumn("mask", F.when((F.col("r") + F.col("c")) % 7 == 0, 0).otherwise(1))
    found = sensors.index_tiles(px, [f"band_{i}" for i in range(N_REFLECTANCES)], mask=mask, factor=5, ndvi_least=-0.5, blue_most=3500.0)
    path = fresh_path(spark, "indices")
    rasters.write_mosaic(found, path, ["mask", *INDICES])
    read = rasters.read_raster(spark, path)
    return rounded(read.select("r", "c", F.col("mask").cast("int").alias("mask"), *INDICES))


QUERIES = {f.__name__: f for f in (raster_interleaves, raster_header, mosaic_overlap, written_map, index_tiles)}

_REFLECTANCES = ", ".join(f"((event_id * {7 + 2 * i} + minute)::bigint % 4000 + 1)::double as {b}" for i, b in enumerate(sensors.SENTINEL_2[10]))

ORACLE_SQL = {
    "index_tiles": f"""with {PIXELS_SQL}, f as (select r, c, {_REFLECTANCES} from px), b as (select *, (B08 - B04) / (B08 + B04) as ndvi, 0.371 + 1.5 * (B08 - B04) / (B08 + B04 + 0.5) as inner_ from f),
 m as (select *, case when (r // 5 + c // 5) % 7 = 0 or B02 > 3500 or ndvi < -0.5 then 0 else 1 end as mask from b)
 select r, c, mask, case when mask = 1 then round(ndvi, 6) end as ndvi, case when mask = 1 then round(B11 / (B8A + (1613.7 - 864.8) * (B12 - B8A) / (2202.4 - 864.8)), 6) end as cr_swir,
  case when mask = 1 and inner_ > 0 then round(-ln(case when inner_ > 0 then inner_ end) / 2.4, 6) end as lai_savi from m""",
    "raster_interleaves": f"with {PIXELS_SQL} select unnest(['bsq', 'bil', 'bip']) as interleave, r, c, value, k from px where r between {LINES[0]} and {LINES[1]}",
    "raster_header": f"with {PIXELS_SQL} select min(r) + 1 as y_start, min(c) + 1 as x_start, max(r) - min(r) + 1 as lines, max(c) - min(c) + 1 as samples, 3::bigint as bands, 'bil' as interleave, '{', '.join(BANDS)}' as band_names, 1::bigint as n_lines from px group by tile",
    "mosaic_overlap": f"""with {PIXELS_SQL}, t as (select unnest(range((select (max(r) + {MARGIN}) // {TILE_ROWS} + 1 from px))) as t), a as (select r, c, t, case when (event_id + t) % 4 <> 0 then value + 1000 * t end as v from px join t on r between t * {TILE_ROWS} - {MARGIN} and t * {TILE_ROWS} + {TILE_ROWS - 1 + MARGIN})
 select r, c, first(v order by t) as value from a where v is not null group by r, c""",
    "written_map": f"with {PIXELS_SQL} select tile, r, c, value, case when tile = 1 then -1.0::double else k end as k from px where r between {LINES[0]} and {LINES[1]}",
}
