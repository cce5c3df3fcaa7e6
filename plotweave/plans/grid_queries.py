"""Queries over the raster of events."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.operators import alpha as alpha_ops
from plotweave.operators import beta as beta_ops
from plotweave.operators import functional as fd_ops
from plotweave.operators import masks, plots, sampling, search, transforms, windows
from plotweave.operators import ordination as ord_ops
from plotweave.plans import workflows
from plotweave.plans.bindings import BANDS, N_COLS, PIXELS_SQL, pixels, rounded
from plotweave.plans.options import Options, for_entry
from plotweave.sources import maps
from plotweave.sources.shared import fresh_path

WINDOW, SUN, PCELIM = 10, 0.25, 0.02
WIN_SQL = "(r // 10 * 10 + c // 10 + 1)"
#: A draw's order that both engines can compute.
PORTABLE_SQL = "(event_id * 7919) % 10007"
METRICS = ("richness", "shannon", "simpson")


def portable():
    return (F.col("event_id") * 7919) % 10007


def windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).withColumn("win_id", windows.window_id(F.col("r"), F.col("c"), WINDOW, N_COLS))


def alpha_sql(counts: str, keys: str, least: float | None = None, hill: bool = False) -> str:
    """SQL of the alpha metrics of a relation ``keys, cid, n``."""
    having = "" if least is None else f" and t > {least}"
    more = ", round(exp(0.0 - sum(p * ln(p))), 6) as hill" if hill else ""
    return f"""a as (select *, sum(n) over (partition by {keys}) as t from {counts} as q),
 s as (select *, n * 1.0 / sum(n) over (partition by {keys}) as p from a where n >= {PCELIM}::double * t{having})
 select {keys}, count(*) as richness, round(0.0 - sum(p * ln(p)), 6) as shannon, round(1 - sum(p * p), 6) as simpson{more} from s group by {keys}"""


def alpha_grid(spark, sf_dir):
    counts = alpha_ops.species_counts(windowed(spark, sf_dir), ["win_id"], "event_type")
    return rounded(alpha_ops.alpha(counts, ["win_id"], METRICS, pcelim=PCELIM, min_pixels=SUN * WINDOW**2))


def alpha_plots(spark, sf_dir):
    counts = alpha_ops.species_counts(pixels(spark, sf_dir), ["user_id"], "event_type")
    return rounded(alpha_ops.alpha(counts, ["user_id"], (*METRICS, "hill"), pcelim=PCELIM))


def alpha_classif(spark, sf_dir):
    numbers = workflows.class_numbers(pixels(spark, sf_dir), "event_type").withColumnRenamed("class", "event_type")
    numbered = windowed(spark, sf_dir).join(numbers, "event_type")
    return rounded(workflows.class_diversity(numbered, "cid", ["win_id"], for_entry("classes", window=WINDOW)))


def beta_classif(spark, sf_dir):
    """Distances between the places of windows by their classes: of both signs of an axis the same."""
    found = workflows.class_beta(windowed(spark, sf_dir), "event_type", ["win_id"], for_entry("classes", window=WINDOW))
    return rounded(found.select("win_id", F.transform("coord", F.abs).alias("x")).select("win_id", F.posexplode("x").alias("axis", "place")))


def alpha_moving_window(spark, sf_dir):
    return rounded(workflows.moving_diversity(pixels(spark, sf_dir), "event_type", Options(window=3, alpha_metrics=METRICS)))


def alpha_tiles(spark, sf_dir):
    options = Options(window=WINDOW, alpha_metrics=METRICS)
    return rounded(workflows.class_diversity(windowed(spark, sf_dir), "event_type", ["tile", "win_id"], options))


def mosaic_tiles(spark, sf_dir):
    options = Options(window=WINDOW, alpha_metrics=METRICS)
    px = windowed(spark, sf_dir)
    parts = [px.filter("tile = 0"), px.filter("tile <> 0")]
    return rounded(maps.mosaic([workflows.class_diversity(p, "event_type", ["tile", "win_id"], options) for p in parts]))


def map_layers(spark, sf_dir):
    return maps.long_map(alpha_grid(spark, sf_dir).withColumn("richness", F.col("richness").cast("double")), ["win_id"], METRICS)


def window_ids(spark, sf_dir):
    return windowed(spark, sf_dir).select("event_id", windows.window_id(F.col("r"), F.col("c"), 7, N_COLS).alias("win_7"), "win_id", windows.coarse(F.col("r"), 3).alias("coarse_r"))


def sunlit_windows(spark, sf_dir):
    counts = windowed(spark, sf_dir).filter("value > 10").groupBy("win_id").agg(F.count(F.lit(1)).alias("n"))
    return windows.enough_pixels(counts, ["win_id"], 0.5 * WINDOW**2)


def iqr_bounds(spark, sf_dir):
    return rounded(masks.iqr_bounds(pixels(spark, sf_dir), BANDS))


def iqr_mask(spark, sf_dir):
    px = pixels(spark, sf_dir)
    return masks.within(px, masks.iqr_bounds(px, BANDS, 0.3), BANDS).select("event_id", "mask")


def tile_masks(spark, sf_dir):
    px = pixels(spark, sf_dir)
    return masks.tile_mask(px, masks.iqr_bounds(px, BANDS, 0.3), BANDS).select("tile", "event_id", "mask")


def clean_rows(spark, sf_dir):
    e = F.col("event_id")
    broken = F.when(e % 7 == 0, F.lit(float("nan"))).when(e % 11 == 0, F.lit(None)).when(e % 13 == 0, F.lit(float("-inf"))).otherwise(F.col("value"))
    return masks.clean(pixels(spark, sf_dir).withColumn("value", broken), BANDS).select("event_id", "value")


def scale_bands(spark, sf_dir):
    px = pixels(spark, sf_dir)
    return rounded(transforms.scale(px, masks.iqr_bounds(px, BANDS), BANDS).select("event_id", *BANDS))


def noise_diff(spark, sf_dir):
    return rounded(transforms.noise(pixels(spark, sf_dir), ["value", "k"]))


def sample_pixels(spark, sf_dir):
    return sampling.sample_pixels(pixels(spark, sf_dir), 500, "event_id", portable()).select("event_id", "value")


def pixels_per_lot(spark, sf_dir):
    px = pixels(spark, sf_dir).withColumn("mask", (F.col("value") > 10).cast("int"))
    return spark.createDataFrame([(sampling.pixels_per_iteration(px, 10, 5000, "mask"),)], "n bigint")


def sample_regular_tiles(spark, sf_dir):
    return sampling.sample_tiles(pixels(spark, sf_dir), "tile", 300, "event_id").select("tile", "event_id")


def sample_random_tiles(spark, sf_dir):
    return sampling.sample_tiles(pixels(spark, sf_dir), "tile", 300, "event_id", regular=False, order=portable()).select("tile", "event_id")


def sample_plots(spark, sf_dir):
    own = sampling.sample_plots(pixels(spark, sf_dir), 40, "event_id", 5, 0.7, portable())
    return rounded(own.groupBy("plot_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value")))


def sample_tile_plots(spark, sf_dir):
    own = sampling.sample_tile_plots(pixels(spark, sf_dir), "tile", 4, "event_id", 5, 0.7, order=portable())
    return rounded(own.groupBy("tile", "plot_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value")).select("tile", F.col("plot_id").cast("bigint").alias("plot_id"), "n", "mean_value"))


def tile_samples(spark, sf_dir):
    """How many pixels of every tile the species are fitted on, and the ordination's plots with theirs."""
    alpha, beta = sampling.sample_all_tiles(pixels(spark, sf_dir), "tile", "event_id", 300, 20, 5, portable())
    count = F.count(F.lit(1)).alias("n")
    sizes = alpha.groupBy("tile").agg(count).select("tile", F.lit(0).cast("bigint").alias("plot_id"), "n")
    return sizes.unionByName(beta.groupBy("tile", "plot_id").agg(count).withColumn("plot_id", F.col("plot_id").cast("bigint")))


def tile_stats(spark, sf_dir):
    part = sampling.sample_fraction(pixels(spark, sf_dir), "tile", 0.25, "event_id", portable())
    return rounded(masks.iqr_bounds(part, ["value"], 1.5, ["tile"]))


def valid_pixels(spark, sf_dir):
    px = pixels(spark, sf_dir).withColumn("mask", (F.col("k") > 20).cast("int"))
    return masks.valid_pixels(px, "tile", "value", "mask")


BOXES = [(1, 0, 4, 10, 30), (2, 3, 8, 40, 49), (3, 5, 9, 90, 120), (4, 50, 60, 0, 15)]


def _boxes(spark, rows):
    return spark.createDataFrame(rows, "local_id bigint, r0 bigint, r1 bigint, c0 bigint, c1 bigint")


def extract_plots(spark, sf_dir):
    px = pixels(spark, sf_dir).withColumn("mask", (F.col("k") > 30).cast("int"))
    boxes = _boxes(spark, BOXES).withColumnRenamed("local_id", "plot_id")
    own = plots.extract(px, boxes, BANDS, "mask", 0.6)
    return rounded(own.groupBy("plot_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value")))


def plot_layers(spark, sf_dir):
    all_plots = plots.numbered([("north", _boxes(spark, BOXES[:2])), ("south", _boxes(spark, BOXES[2:]))])
    own = plots.extract(pixels(spark, sf_dir), all_plots, BANDS)
    counts = own.groupBy("plot_id").agg(F.count(F.lit(1)).alias("n"))
    return plots.with_attributes(all_plots.select("plot_id", "source", "local_id"), counts)


COORDINATES = [(0, 5), (3, 50), (9, 99), (200, 3), (2, 500)]


def cells_at_coords(spark, sf_dir):
    cells = spark.createDataFrame(COORDINATES, "r bigint, c bigint")
    return sampling.cells_at(pixels(spark, sf_dir), cells).select("r", "c", "event_id", "value")


def plot_values(spark, sf_dir):
    listed = sampling.values_in_plots(pixels(spark, sf_dir), "user_id", "k")
    return listed.select("user_id", F.size("values").cast("bigint").alias("n"), F.array_join(F.transform("values", lambda x: x.cast("bigint").cast("string")), ",").alias("listed"))


def functional_1d(spark, sf_dir):
    # Rounded twice on both sides: some values are halves of the last digit.
    return rounded(rounded(fd_ops.functional_1d(pixels(spark, sf_dir), ["user_id"], "value"), 10))


def functional_hull(spark, sf_dir):
    px = pixels(spark, sf_dir)
    scaled = transforms.scale(px, masks.iqr_bounds(px, BANDS), BANDS).withColumn("win_id", windows.window_id(F.col("r"), F.col("c"), WINDOW, N_COLS))
    return rounded(fd_ops.functional(scaled, ["win_id"], BANDS))


def functional_traits(spark, sf_dir):
    """Dispersion and quadratic entropy of three traits."""
    # Rounded twice on both sides: some values are halves of the last digit.
    return rounded(rounded(fd_ops.functional(windowed(spark, sf_dir), ["win_id"], BANDS, ("fdis", "raoq")), 9))


def mnf_scores(spark, sf_dir):
    px = pixels(spark, sf_dir)
    model = ord_ops.fit_mnf(px, transforms.noise(px, BANDS), BANDS)
    return rounded(ord_ops.rotate(px, model, ["event_id"]))


def mnf_ratios(spark, sf_dir):
    """Components by noise: each one's variance over that of its noise is its eigenvalue, and they add up to the trace of noise^-1 covariance."""
    px, bands = pixels(spark, sf_dir), ["value", "k"]
    noise = transforms.noise(px, bands)
    model = ord_ops.fit_mnf(px, noise, bands)
    names = ["pc1", "pc2"]
    signal, rest = (np.diag(ord_ops.moments(ord_ops.rotate(t, model, []), names)[2]) for t in (px, noise))
    held = bool(np.allclose(signal / rest, model.variance))
    return rounded(spark.createDataFrame([(float(model.variance.sum()), held, bool(model.variance[0] >= model.variance[1]))], "total double, as_fitted boolean, falling boolean"))


def crop_border(spark, sf_dir):
    n_rows = windows.extent(pixels(spark, sf_dir)).first().r_max + 1
    return windows.without_border(pixels(spark, sf_dir), 5, n_rows, N_COLS).select("r", "c", "event_id")


def grid_extent(spark, sf_dir):
    return windows.extent(pixels(spark, sf_dir))


def grid_cells(spark, sf_dir):
    return windows.grid(pixels(spark, sf_dir), 15)


SMALL = Options(window=WINDOW, n_clusters=8, n_iter=3, alpha_metrics=("richness", "shannon", "simpson", "hill", "fisher"), alpha_sample=2000, beta_sample=60, starts=2)


def full_workflow(spark, sf_dir):
    return rounded(workflows.diversity(pixels(spark, sf_dir), BANDS, "event_id", N_COLS, SMALL))


def full_workflow_tiles(spark, sf_dir):
    """Masks, samples by tile, one model, the mosaic of all tiles."""
    return rounded(workflows.tiled_diversity(pixels(spark, sf_dir), BANDS, "tile", "event_id", N_COLS, replace(SMALL, iqr_weight=4.0)))


def _observed(px: DataFrame) -> DataFrame:
    """Shannon's entropy of the event types of each plot, as ``value``."""
    found = alpha_ops.alpha(alpha_ops.species_counts(px, ["user_id"], "event_type"), ["user_id"], ["shannon"])
    return found.select(F.col("user_id").alias("plot_id"), F.col("shannon").alias("value"))


def forward_selection(spark, sf_dir):
    """Which bands' species, fitted on all pixels, follow the entropy of event types of each plot."""
    px = pixels(spark, sf_dir)
    own = px.withColumnRenamed("user_id", "plot_id")
    options = Options(n_clusters=6, n_iter=2, starts=1)
    criterion = workflows.feature_criterion(own, own, _observed(px), "event_id", "shannon", options)
    return rounded(spark.createDataFrame(search.select_forward(BANDS, criterion, 2), "round int, band string, r double"))


def forward_selection_functional(spark, sf_dir):
    px = pixels(spark, sf_dir)
    own = px.withColumnRenamed("user_id", "plot_id")
    criterion = workflows.feature_criterion(px, own, _observed(px), "event_id", "fdis", Options())
    return rounded(spark.createDataFrame(search.select_forward(BANDS, criterion, 1), "round int, band string, r double"))


def _blocks(spark, sf_dir) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Pixels by plots of 20 x 20, and what their event types say of alpha and beta diversity: for the latter the shares of types, as pairs are quadratic."""
    px = pixels(spark, sf_dir).withColumn("plot_id", windows.window_id(F.col("r"), F.col("c"), 20, N_COLS))
    counts = alpha_ops.species_counts(px, ["plot_id"], "event_type")
    alpha = alpha_ops.alpha(counts, ["plot_id"], ["shannon", "simpson"])
    found = {m: alpha.select("plot_id", F.col(m).alias("value")) for m in ("shannon", "simpson")}
    found["fdis"] = found["shannon"]
    found["bc"] = beta_ops.species_shares(counts, ["plot_id"])
    return px, found


def forward_selection_report(spark, sf_dir):
    """Every metric of every candidate of a selection by Bray-Curtis dissimilarity."""
    px, observed = _blocks(spark, sf_dir)
    criterion = workflows.feature_criterion(sampling.sample_pixels(px, 1000, "event_id"), px, observed, "event_id", None, Options(n_clusters=6, n_iter=2, starts=1))
    return rounded(spark.createDataFrame(search.forward_report(BANDS, criterion, "bc"), "round int, band string, metric string, r double, chosen boolean"))


def cluster_search_beta(spark, sf_dir):
    px, observed = _blocks(spark, sf_dir)
    sample = sampling.sample_pixels(px, 1000, "event_id")
    return rounded(search.cluster_search(sample, px, observed["bc"], masks.iqr_bounds(px, BANDS), BANDS, (4, 8), 2, "bc", "event_id", 1))


def plot_workflow(spark, sf_dir):
    """Field plots with attributes: alpha, functional metrics and both ordinations."""
    px = pixels(spark, sf_dir)
    options = Options(n_clusters=6, n_iter=2, alpha_metrics=("richness", "shannon"), fd_metrics=("fdis",), beta_sample=40, alpha_sample=1000, window=5, starts=1)
    model = workflows.fit(px, BANDS, "event_id", options)
    boxes = _boxes(spark, BOXES).withColumnRenamed("local_id", "plot_id")
    return rounded(workflows.plot_diversity(plots.extract(px, boxes, BANDS), boxes, model, options))


def cluster_search(spark, sf_dir):
    px = pixels(spark, sf_dir)
    sample = sampling.sample_pixels(px, 1000, "event_id")
    own = px.withColumnRenamed("user_id", "plot_id")
    return rounded(search.cluster_search(sample, own, _observed(px), masks.iqr_bounds(px, BANDS), BANDS, (4, 8), 2, key="event_id", starts=1))


def cluster_runs_kept(spark, sf_dir):
    """All repetitions of a search, kept in the shared folder; a second call takes them from there."""
    px, observed = _blocks(spark, sf_dir)
    folder = fresh_path(spark, "search")
    run = lambda: search.stored_runs(folder, sampling.sample_pixels(px, 1000, "event_id"), px, observed["shannon"], masks.iqr_bounds(px, BANDS), BANDS, (3, 5), 2, metric="shannon", key="event_id", starts=1)
    first = run().withColumnRenamed("cost", "first")
    both = first.join(run().select("k", "repeat", "cost"), ["k", "repeat"])
    return both.select("k", "repeat", F.col("pearson").between(-1, 1).alias("correlated"), (F.col("first") == F.col("cost")).alias("same"))


QUERIES = {f.__name__: f for f in (cluster_runs_kept, alpha_grid, alpha_plots, alpha_classif, beta_classif, alpha_moving_window, alpha_tiles, mosaic_tiles, map_layers, window_ids, sunlit_windows, iqr_bounds, iqr_mask, tile_masks, clean_rows, scale_bands, noise_diff, sample_pixels, pixels_per_lot, sample_regular_tiles, sample_random_tiles, sample_plots, sample_tile_plots, tile_samples, tile_stats, valid_pixels, extract_plots, plot_layers, cells_at_coords, plot_values, functional_1d, functional_hull, functional_traits, mnf_scores, mnf_ratios, crop_border, grid_extent, grid_cells, full_workflow, full_workflow_tiles, plot_workflow, forward_selection, forward_selection_functional, forward_selection_report, cluster_search, cluster_search_beta)}

_WINDOWS = f"(select {WIN_SQL} as win_id, event_type as cid, count(*) as n from px group by 1, 2)"
_TILED = f"(select tile, {WIN_SQL} as win_id, event_type as cid, count(*) as n from px group by 1, 2, 3)"
_BOUNDS = lambda weight, source="px": ", ".join(f"(select quantile_cont({b}, 0.25) - {weight} * (quantile_cont({b}, 0.75) - quantile_cont({b}, 0.25)) from {source}) as {b}_lo, (select quantile_cont({b}, 0.75) + {weight} * (quantile_cont({b}, 0.75) - quantile_cont({b}, 0.25)) from {source}) as {b}_hi" for b in BANDS)
_WITHIN = " and ".join(f"{b} between {b}_lo and {b}_hi" for b in BANDS)
_BOX_ROWS = ", ".join(map(str, BOXES))
_PLOT_SQL = f"""o as (select unnest(range(-2, 3)) as d),
 ranked as (select *, row_number() over (order by {PORTABLE_SQL}, event_id) as i from px)"""
_QUOTAS = """q as (select tile, count(*) as n, round(count(*) * least(1.0, 300.0 / (select count(*) from px)))::bigint as quota from px group by tile)"""

ORACLE_SQL = {
    "cluster_runs_kept": "select k::int as k, r::int as repeat, true as correlated, true as same from (select unnest([3, 5]) as k), (select unnest([1, 2]) as r), (select count(*) as n from events) where n > 0",
    "alpha_grid": f"with {PIXELS_SQL}, {alpha_sql(_WINDOWS, 'win_id', SUN * WINDOW**2)}",
    "alpha_plots": f"with {PIXELS_SQL}, {alpha_sql('(select user_id, event_type as cid, count(*) as n from px group by 1, 2)', 'user_id', hill=True)}",
    "alpha_classif": f"with {PIXELS_SQL}, {alpha_sql(_WINDOWS, 'win_id', SUN * WINDOW**2, True)}",
    "alpha_moving_window": f"""with {PIXELS_SQL}, d as (select unnest(range(-1, 2)) as d),
 m as (select px.r + y.d as r, px.c + x.d as c, event_type as cid, count(*) as n from px, d as y, d as x group by 1, 2, 3),
 w as (select m.* from m join px on m.r = px.r and m.c = px.c), {alpha_sql('w', 'r, c', SUN * 9)}""",
    "alpha_tiles": f"with {PIXELS_SQL}, {alpha_sql(_TILED, 'tile, win_id', SUN * WINDOW**2)}",
    "mosaic_tiles": f"with {PIXELS_SQL}, {alpha_sql(_TILED, 'tile, win_id', SUN * WINDOW**2)}",
    "map_layers": f"with {PIXELS_SQL}, g as (with {alpha_sql(_WINDOWS, 'win_id', SUN * WINDOW**2)}) select win_id, 'richness' as metric, richness::double as value from g union all select win_id, 'shannon', shannon from g union all select win_id, 'simpson', simpson from g",
    "window_ids": f"with {PIXELS_SQL} select event_id, r // 7 * 15 + c // 7 + 1 as win_7, {WIN_SQL} as win_id, r // 3 as coarse_r from px",
    "sunlit_windows": f"with {PIXELS_SQL} select {WIN_SQL} as win_id, count(*) as n from px where value > 10 group by 1 having count(*) > 50",
    "iqr_bounds": f"with {PIXELS_SQL}, b as (select {_BOUNDS(3)}) " + " union all ".join(f"select '{b}' as band, round({b}_lo, 6) as low, round({b}_hi, 6) as high from b" for b in BANDS),
    "iqr_mask": f"with {PIXELS_SQL}, b as (select {_BOUNDS(0.3)}) select event_id, case when {_WITHIN} then 1 else 0 end as mask from px, b",
    "tile_masks": f"with {PIXELS_SQL}, b as (select {_BOUNDS(0.3)}) select tile, event_id, case when {_WITHIN} then 1 end as mask from px, b",
    "clean_rows": f"with {PIXELS_SQL} select event_id, value from px where event_id % 7 <> 0 and event_id % 11 <> 0 and event_id % 13 <> 0",
    "scale_bands": f"with {PIXELS_SQL}, b as (select {_BOUNDS(3)}) select event_id, " + ", ".join(f"round(({b} - {b}_lo) / ({b}_hi - {b}_lo), 6) as {b}" for b in BANDS) + " from px, b",
    "noise_diff": f"""with {PIXELS_SQL}, l as (select r, c, value, k, lag(value) over x as vx, lag(value) over y as vy, lag(k) over x as kx, lag(k) over y as ky from px
 window x as (partition by r order by c), y as (partition by c order by r))
 select r, c, round((2 * value - vx - vy) / 2, 6) as value, round((2 * k - kx - ky) / 2, 6) as k from l where vx is not null and vy is not null""",
    "mnf_ratios": f"""with {PIXELS_SQL}, l as (select r, c, value, k, lag(value) over x as vx, lag(value) over y as vy, lag(k) over x as kx, lag(k) over y as ky from px
 window x as (partition by r order by c), y as (partition by c order by r)),
 n as (select (2 * value - vx - vy) / 2 as a, (2 * k - kx - ky) / 2 as b from l where vx is not null and vy is not null),
 m as (select var_samp(a) as aa, covar_samp(a, b) as ab, var_samp(b) as bb from n), s as (select var_samp(value) as aa, covar_samp(value, k) as ab, var_samp(k) as bb from px)
 select round((m.bb * s.aa - 2 * m.ab * s.ab + m.aa * s.bb) / (m.aa * m.bb - m.ab * m.ab), 6) as total, true as as_fitted, true as falling from m, s""",
    "sample_pixels": f"with {PIXELS_SQL} select event_id, value from px order by {PORTABLE_SQL}, event_id limit 500",
    "pixels_per_lot": f"with {PIXELS_SQL} select least(5000, count(*)) // 10 as n from px where value > 10",
    "sample_regular_tiles": f"with {PIXELS_SQL}, {_QUOTAS}, i as (select tile, event_id, row_number() over (partition by tile order by event_id) as i from px) select tile, event_id from i join q using (tile) where (i * quota) // n > ((i - 1) * quota) // n",
    "sample_random_tiles": f"with {PIXELS_SQL}, {_QUOTAS}, i as (select tile, event_id, row_number() over (partition by tile order by {PORTABLE_SQL}, event_id) as i from px) select tile, event_id from i join q using (tile) where i <= quota",
    "sample_plots": f"with {PIXELS_SQL}, {_PLOT_SQL} select a.event_id as plot_id, count(*) as n, round(avg(px.value), 6) as mean_value from ranked as a, o as y, o as x, px where a.i <= 40 and px.r = a.r + y.d and px.c = a.c + x.d group by 1 having count(*) >= 0.7 * 25",
    "sample_tile_plots": f"""with {PIXELS_SQL}, o as (select unnest(range(-2, 3)) as d), a as (select *, row_number() over (partition by tile order by {PORTABLE_SQL}, event_id) as i from px),
 g as (select a.tile, a.i, count(*) as n, avg(px.value) as m from a, o as y, o as x, px where a.i <= 9 and px.tile = a.tile and px.r = a.r + y.d and px.c = a.c + x.d group by 1, 2 having count(*) > 0.7 * 25),
 k as (select *, row_number() over (partition by tile order by i) as j from g)
 select tile, row_number() over (order by tile, i) as plot_id, n, round(m, 6) as mean_value from k where j <= 4""",
    "tile_samples": f"""with {PIXELS_SQL}, {_QUOTAS}, o as (select unnest(range(-2, 3)) as d),
 u as (select tile, ceil(count(*) * least(1.0::double, 20.0::double / (select count(*) from px)))::bigint as quota from px group by tile),
 a as (select *, row_number() over (partition by tile order by {PORTABLE_SQL}, event_id) as i, row_number() over (partition by tile order by event_id) as j from px),
 g as (select a.tile, a.i, count(*) as n from a join u on a.tile = u.tile and a.i <= u.quota + 5, o as y, o as x, px where px.tile = a.tile and px.r = a.r + y.d and px.c = a.c + x.d group by 1, 2 having count(*) > 0.6 * 25),
 k as (select g.*, row_number() over (partition by g.tile order by i) as j from g),
 b as (select k.tile, row_number() over (order by k.tile, i) as plot_id, n from k join u on k.tile = u.tile and k.j <= u.quota)
 select a.tile, 0::bigint as plot_id, count(*) as n from a join q on a.tile = q.tile where (j * quota) // n > ((j - 1) * quota) // n group by 1 union all select tile, plot_id, n from b""",
    "tile_stats": f"""with {PIXELS_SQL}, i as (select *, row_number() over (partition by tile order by {PORTABLE_SQL}, event_id) as i, count(*) over (partition by tile) as n from px),
 q as (select tile, quantile_cont(value, 0.25) as a, quantile_cont(value, 0.75) as b from i where i <= greatest(1, floor(n * 0.25)) group by tile)
 select tile, 'value' as band, round(a - (b - a) * 1.5, 6) as low, round(b + (b - a) * 1.5, 6) as high from q""",
    "valid_pixels": f"with {PIXELS_SQL} select tile, count(*) filter (k > 20) as n_valid from px group by tile",
    "extract_plots": f"with {PIXELS_SQL}, b(plot_id, r0, r1, c0, c1) as (values {_BOX_ROWS}) select plot_id::bigint as plot_id, count(*) filter (k > 30) as n, round(avg(value) filter (k > 30), 6) as mean_value from px, b where r between r0 and r1 and c between c0 and c1 group by 1 having count(*) filter (k > 30) >= 0.6 * count(*)",
    "plot_layers": f"with {PIXELS_SQL}, b(plot_id, r0, r1, c0, c1) as (values {_BOX_ROWS}), k as (select plot_id, count(*) as n from px, b where r between r0 and r1 and c between c0 and c1 group by 1) select b.plot_id::bigint as plot_id, case when b.plot_id <= 2 then 'north' else 'south' end as source, b.plot_id::bigint as local_id, n from b left join k on b.plot_id = k.plot_id",
    "cells_at_coords": f"with {PIXELS_SQL}, x(r, c) as (values {', '.join(map(str, COORDINATES))}) select px.r, px.c, event_id, value from px join x on px.r = x.r and px.c = x.c",
    "plot_values": f"with {PIXELS_SQL} select user_id, count(k) as n, string_agg(k::bigint::varchar, ',' order by k) as listed from px group by 1",
    "functional_1d": f"""with {PIXELS_SQL}, m as (select user_id, max(value) - min(value) as fric, avg(value) as m from px group by 1),
 f as (select px.user_id, avg(abs(value - m)) as fdis from px join m using (user_id) group by 1),
 q as (select a.user_id, avg(abs(a.value - b.value)) as raoq from px as a join px as b on a.user_id = b.user_id group by 1)
 select user_id, round(round(fric, 10), 6) as fric, round(round(fdis, 10), 6) as fdis, round(round(raoq, 10), 6) as raoq from m join f using (user_id) join q using (user_id)""",
    "functional_traits": f"""with {PIXELS_SQL}, v as (select {WIN_SQL} as win_id, event_id, value, minute, k from px where value is not null and minute is not null and k is not null),
 m as (select win_id, avg(value) as a, avg(minute) as b, avg(k) as c from v group by 1 having count(*) > 3),
 f as (select v.win_id, avg(sqrt(power(value - a, 2) + power(minute - b, 2) + power(k - c, 2))) as fdis from v join m on v.win_id = m.win_id group by 1),
 q as (select x.win_id, avg(sqrt(power(x.value - y.value, 2) + power(x.minute - y.minute, 2) + power(x.k - y.k, 2))) as raoq from v as x join v as y on x.win_id = y.win_id group by 1)
 select w.win_id, round(round(fdis, 9), 6) as fdis, round(round(case when fdis is not null then raoq end, 9), 6) as raoq from (select distinct win_id from v) as w left join f on f.win_id = w.win_id left join q on q.win_id = w.win_id""",
    "crop_border": f"with {PIXELS_SQL} select r, c, event_id from px where r between 3 and (select max(r) from px) - 3 and c between 3 and 96",
    "grid_extent": f"with {PIXELS_SQL} select min(r) as r_min, max(r) as r_max, min(c) as c_min, max(c) as c_max from px",
    "grid_cells": f"with {PIXELS_SQL} select r // 15 as cell_r, c // 15 as cell_c, r // 15 * 15 as r_min, r // 15 * 15 + 14 as r_max, c // 15 * 15 as c_min, c // 15 * 15 + 14 as c_max, count(*) as n from px group by all",
}
