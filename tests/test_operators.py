"""Operators against closed forms, invariants and brute force."""

import math
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plotweave.functions import diversity as fd
from plotweave.operators import alpha, beta, functional, masks, ordination, plots, sampling, search, species, transforms, windows
from plotweave.plans import options, workflows
from plotweave.sources import headers, maps

RNG = np.random.default_rng(7)


def counts_frame(spark, rows):
    return spark.createDataFrame(rows, "win int, cid int, n bigint")


def test_fisher_solves_its_equation():
    s, n = np.array([2, 5, 40, 1, 7]), np.array([10, 6, 1000, 5, 7])
    a = fd.solve_fisher(s, n)
    assert np.allclose(a[:3] * np.log1p(n[:3] / a[:3]), s[:3])
    assert np.isnan(a[3]) and np.isnan(a[4])


def test_alpha_invariants(spark):
    rows = [(w, c, int(RNG.integers(1, 50))) for w in range(6) for c in range(1, 2 + w)]
    out = alpha.alpha(counts_frame(spark, rows), ["win"], ("richness", "shannon", "simpson", "hill", "fisher"), hill_order=2, pcelim=0).collect()
    for r in out:
        assert r.shannon <= math.log(r.richness) + 1e-12
        assert math.isclose(r.hill, 1 / (1 - r.simpson))
        assert (r.fisher is None) == (r.richness <= 1)
    profile = alpha.hill_profile(counts_frame(spark, rows), ["win"], (0, 0.5, 1, 2, 3)).collect()
    for r in profile:
        values = list(r)[1:]
        assert all(a >= b - 1e-9 for a, b in zip(values, values[1:], strict=False))


def test_rare_species_are_left_out(spark):
    r = alpha.alpha(counts_frame(spark, [(1, 1, 98), (1, 2, 1), (1, 3, 1)]), ["win"], pcelim=0.02).first()
    assert (r.richness, r.shannon, r.simpson) == (1, 0.0, 0.0)


def test_mean_over_iterations_is_null_where_one_is(spark):
    rows = spark.createDataFrame([(1, 1, 2.0), (1, 2, None), (2, 1, 1.0), (2, 2, 3.0)], "win int, iter int, fisher double")
    found = {r.win: (r.fisher_mean, r.fisher_sd) for r in alpha.over_iterations(rows, ["win"], ["fisher"]).collect()}
    assert found[1] == (None, None) and found[2][0] == 2.0


@pytest.mark.parametrize("strict, kept", [(True, {2}), (False, {1, 2})])
def test_enough_pixels(spark, strict, kept):
    rows = counts_frame(spark, [(1, 1, 25), (2, 1, 20), (2, 2, 6), (3, 1, 24)])
    assert {r.win for r in windows.enough_pixels(rows, ["win"], 25, strict).collect()} == kept


@pytest.mark.parametrize("width", [1, 3, 4])
def test_moving_counts(spark, width):
    cells = [(r, c, int(RNG.integers(3))) for r in range(6) for c in range(7) if (r, c) != (2, 2)]
    got = {(x.r, x.c, x.s): x.n for x in windows.moving_counts(spark.createDataFrame(cells, "r bigint, c bigint, s int"), "s", width).collect()}
    low, high = windows.offsets(width)
    want = {}
    for r, c, _ in cells:
        for y, x, s in cells:
            if low <= y - r <= high and low <= x - c <= high:
                want[r, c, s] = want.get((r, c, s), 0) + 1
    assert got == want


def test_bray_curtis(spark):
    rows = counts_frame(spark, [(1, 1, 5), (1, 2, 5), (2, 1, 5), (2, 3, 5), (3, 9, 1)])
    pairs = {(r.a, r.b): r.bc for r in beta.bray_curtis_pairs(beta.species_shares(rows, ["win"], 0), "win").collect()}
    assert pairs == {(1, 2): 0.5, (1, 3): 1.0, (2, 3): 1.0}
    m = RNG.random((9, 12))
    d = beta.bray_curtis_matrix(m, m, 3, block=2)
    assert np.allclose(d, d.T) and np.allclose(np.diag(d), 0) and (d >= 0).all() and (d <= 1).all()


def test_nearest_places():
    places = np.array([[0.0], [1.0], [5.0]])
    d = np.array([[0.0, 0.0, 0.3], [0.5, 0.25, 1.0]])
    out = beta.nearest_places(d, places)
    assert out[0, 0] == 0.0
    assert math.isclose(out[1, 0], (0 / 0.5 + 1 / 0.25 + 5 / 1) / (1 / 0.5 + 1 / 0.25 + 1))
    assert beta.nearest_places(np.array([[0.2]]), places[:1])[0, 0] == 0.0


def test_principal_coordinates_keep_euclidean_distances():
    x = RNG.normal(size=(12, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    coords, values = ordination.principal_coordinates(d, 3)
    assert np.allclose(np.sqrt(((coords[:, None] - coords[None]) ** 2).sum(2)), d)
    assert np.allclose(coords.mean(0), 0) and (np.diff(values) <= 1e-9).all()


def test_pca_scores_are_uncorrelated(spark):
    x = RNG.normal(size=(200, 3)) @ np.array([[2, 0.3, 0], [0, 1, 0.5], [0.1, 0, 0.4]])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    for standardize in (False, True):
        model = ordination.fit_pca(df, ["a", "b", "c"], standardize)
        scores = np.array(ordination.rotate(df, model, []).collect())
        assert np.allclose(np.cov(scores.T), np.diag(model.variance), atol=1e-8)


def test_mnf_solves_the_eigenproblem(spark):
    cells = [(r, c, float(RNG.normal()), float(RNG.normal() + r)) for r in range(12) for c in range(12)]
    df = spark.createDataFrame(cells, "r bigint, c bigint, a double, b double")
    noise = transforms.noise(df, ["a", "b"])
    assert np.allclose(*(np.array(sorted(map(tuple, x.collect()))) for x in (noise, transforms.noise_by_lag(df, ["a", "b"]))))
    model = ordination.fit_mnf(df, noise, ["a", "b"])
    cov, cov_noise = (np.cov(np.array(x.select("a", "b").collect()).T) for x in (df, noise))
    for k in range(2):
        v = model.rotation[:, k]
        assert np.allclose(np.linalg.solve(cov_noise, cov) @ v, model.variance[k] * v)


def test_hull_above_spectrum():
    wl = np.linspace(400, 2400, 40)
    for _ in range(20):
        x = RNG.random(40)
        hull = transforms.upper_hull(x, wl)
        assert (hull >= x - 1e-12).all() and hull[0] == x[0] and hull[-1] == x[-1]
        assert (np.diff(np.diff(hull) / np.diff(wl)) <= 1e-12).all()
        assert (transforms.remove_continuum(x, wl) <= 1 + 1e-12).all()


def test_splines():
    x = np.array([0.0, 1, 2.5, 4, 7])
    cubic = lambda t: 2 - t + 0.5 * t**2 - 0.25 * t**3
    at = np.linspace(0, 7, 30)
    assert np.allclose(transforms.cubic_spline(x, cubic(x), at), cubic(at))
    assert np.allclose(transforms.cubic_spline(x[:3], x[:3] ** 2, at[:10]), at[:10] ** 2)
    assert np.allclose(transforms.cubic_spline(x[:2], x[:2], at[:3]), at[:3])
    wl = np.linspace(400, 900, 12)
    spectrum = RNG.random(12)
    keep = transforms.hull_points(spectrum, wl)
    assert np.allclose(transforms.upper_hull(spectrum, wl, True)[keep], spectrum[keep])
    flat = transforms.remove_continuum(np.full(5, 2.0), wl[:5], subtract=True)
    assert np.allclose(flat, 1) and np.allclose(transforms.remove_continuum(np.full(5, 2.0), wl[:5], absorbance=True), 0)


def test_continuum_of_odd_spectra(spark):
    rows = [(1, [1.0, 1.0, 1.0, 1.0]), (2, None), (3, [0.2, -1.0, 0.4, 0.3])]
    got = {r.i: r.cr for r in transforms.continuum_removed(spark.createDataFrame(rows, "i int, s array<double>"), [410.0, 420.0, 430.0, 440.0], "i", "s").collect()}
    assert got[1] == got[2] == [0.0, 0.0] and got[3] == [0.0, 1.0]


def test_flat_band_raises(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "a double")
    with pytest.raises(ValueError, match="without range"):
        transforms.scale(df, masks.iqr_bounds(df, ["a"]), ["a"])


def test_hulls():
    cube = np.array([[x, y, z] for x in (0, 1) for y in (0, 1) for z in (0, 1)] + [[0.5, 0.5, 0.5]], float)
    vertices, volume = functional.hull(cube)
    assert math.isclose(volume, 1) and vertices == list(range(8))
    square = np.array([[0, 0], [2, 0], [2, 1], [0, 1], [1, 0.5]], float)
    assert math.isclose(functional.hull(square)[1], 2)
    assert functional.hull(np.array([[0.0, 0], [1, 1], [2, 2]])) is None
    assert functional.hull(np.array([[3.0], [1.0], [2.0]])) == ([0, 1], 2.0)
    four = np.vstack([np.zeros(4), np.eye(4)])
    assert math.isclose(functional.hull(four)[1], 1 / 24)


def test_hull_holds_all_points():
    for d in (2, 3, 4):
        x = RNG.normal(size=(40, d))
        vertices, volume = functional.hull(x)
        inner = functional.hull(x[vertices])
        assert math.isclose(volume, inner[1], rel_tol=1e-9) and volume > 0


def test_spanning_tree_and_evenness():
    x = RNG.normal(size=(7, 2))
    d = {(i, j): float(np.linalg.norm(x[i] - x[j])) for i, j in combinations(range(7), 2)}
    part, total = list(range(7)), 0.0
    for (i, j), w in sorted(d.items(), key=lambda kv: kv[1]):
        if part[i] != part[j]:
            total += w
            part = [part[i] if p == part[j] else p for p in part]
    assert math.isclose(functional.spanning_tree(x).sum(), total)
    assert math.isclose(functional.evenness(np.array([[0.0], [1], [2], [3]])), 1)
    assert functional.evenness(np.array([[1.0], [1.0], [1.0]])) is None


def test_functional_one_trait_agrees(spark):
    rows = [(int(i % 3), float(v)) for i, v in enumerate(RNG.normal(size=60))]
    df = spark.createDataFrame(rows, "w int, x double")
    a = {r.w: r for r in functional.functional(df, ["w"], ["x"]).collect()}
    for r in functional.functional_1d(df, ["w"], "x").collect():
        assert math.isclose(r.fric, a[r.w].fric) and math.isclose(r.fdis, a[r.w].fdis) and math.isclose(r.raoq, a[r.w].raoq)
    few = spark.createDataFrame([(1, 1.0)], "w int, x double")
    assert functional.functional(few, ["w"], ["x"]).first().fric is None


def test_assign_both_ways(spark):
    rows = [(i, [float(v) for v in RNG.normal(size=4)]) for i in range(30)]
    df = spark.createDataFrame(rows, "i int, x array<double>")
    centers = RNG.normal(size=(5, 4))
    table = spark.createDataFrame([(1, k + 1, [float(v) for v in c]) for k, c in enumerate(centers)], "iter int, cid int, center array<double>")
    a = {r.i: r.species[0] for r in species.assign(df, [centers], "x", ["i"]).collect()}
    b = {r.i: r.cid for r in species.assign_native(df, table, "x", "i").collect()}
    assert a == b
    same = np.zeros((2, 4))
    assert {r.species[0] for r in species.assign(df, [same], "x", ["i"]).collect()} == {1}


def test_kmeans_finds_clusters():
    centers = np.array([[0.0, 0], [10, 0], [0, 10]])
    x = np.vstack([c + RNG.normal(scale=0.2, size=(40, 2)) for c in centers])
    found, cost = species.kmeans(x, 3, 5, 50, 1)
    assert np.allclose(sorted(map(tuple, np.round(found))), sorted(map(tuple, centers)))
    assert cost <= species.kmeans(x, 2, 5, 50, 1)[1]


def test_model_survives_storage(spark, tmp_path):
    df = spark.createDataFrame([(i, float(v), float(v * v)) for i, v in enumerate(RNG.normal(size=80))], "i bigint, a double, b double")
    model = species.fit_species(df, ["a", "b"], "i", 2, 4, starts=1)
    model.save(str(tmp_path))
    again = species.SpeciesModel.load(spark, str(tmp_path), ["a", "b"])
    assert all(np.allclose(x, y) for x, y in zip(model.arrays(), again.arrays(), strict=True))
    assert model.centroids.groupBy("iter").count().collect()[0]["count"] == 4


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(1000).withColumnRenamed("id", "i").withColumn("t", F.col("i") % 3)
    for draw in (lambda d: sampling.sample_pixels(d, 50, "i"), lambda d: sampling.sample_tiles(d, "t", 60, "i"), lambda d: sampling.sample_tiles(d, "t", 60, "i", regular=False)):
        a, b = (sorted(r.i for r in draw(df.repartition(n)).collect()) for n in (1, 13))
        assert a == b and len(a) in (50, 60) and len(set(a)) == len(a)
    with pytest.raises(ValueError):
        sampling.sample_pixels(df, 2000, "i", strict=True)


def test_ring(spark):
    cells = spark.createDataFrame([(r, c, 1.0) for r in range(12) for c in range(12)], "r bigint, c bigint, v double")
    ring = [(0.5, 0.5), (10.5, 0.5), (0.5, 10.5)]
    plot = spark.createDataFrame([(1, 0, 11, 0, 11, ring)], "plot_id bigint, r0 bigint, r1 bigint, c0 bigint, c1 bigint, ring array<struct<x:double,y:double>>")
    got = {(x.r, x.c) for x in plots.extract(cells, plot.selectExpr("plot_id", "array(ring) as rings"), ["v"], rings="rings").collect()}
    assert got == {(r, c) for r in range(1, 11) for c in range(1, 11) if r + c < 11}


def test_clean_and_radiometry(spark):
    rows = [(1, 1.0), (2, None), (3, float("nan")), (4, float("inf")), (5, float("-inf"))]
    assert [r.i for r in masks.clean(spark.createDataFrame(rows, "i int, v double"), ["v"]).collect()] == [1]
    px = spark.createDataFrame([(100.0, 500.0, 3000.0), (600.0, 500.0, 3000.0), (100.0, 500.0, 1000.0), (100.0, 2000.0, 3000.0), (100.0, 0.0, 0.0), (None, 1.0, 3000.0)], "b double, r double, n double")
    assert [r.m for r in px.select(masks.radiometric_mask(F.col("b"), F.col("r"), F.col("n")).alias("m")).collect()] == [1, 0, 0, 0, 0, 0]


def test_bands(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0), (float("inf"), 2.0)], "a double, b double")
    kept, bands = masks.drop_invariant(df, ["a", "b"])
    assert bands == ["a"] and kept.count() == 2
    masks.require_bands(masks.band_catalog(df, [400.0, 500.0]))
    with pytest.raises(ValueError, match="nanometres"):
        masks.require_bands(masks.band_catalog(df, [0.4, 0.5]))
    assert [r.name for r in df.select(masks.named({"a": "name"})).limit(1).select(F.lit("x").alias("name")).collect()] == ["x"]


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert search.correlation(df, "x", "y").first().r is None


def test_select_forward(spark):
    worth = {"a": 0.1, "b": 0.9, "c": 0.5}
    criterion = lambda sets: spark.createDataFrame([(i, sum(worth[f] for f in s)) for i, s in enumerate(sets)], "candidate int, r double")
    assert [x[1] for x in search.select_forward(["a", "b", "c"], criterion)] == ["b", "c", "a"]


def test_headers(spark, tmp_path):
    (tmp_path / "a.hdr").write_text("ENVI\nsamples = 3\nband names = {a,\n b}\nWavelength = {1, 2.5}\n")
    got = {r.name: (r.value, r.numbers) for r in headers.read_headers(spark, str(tmp_path / "a.hdr")).collect()}
    assert got == {"samples": ("3", [3.0]), "band names": ("a,\n b", None), "wavelength": ("1, 2.5", [1.0, 2.5])}
    for name, text in (("b.hdr", "nothing\n"), ("c.hdr", "ENVI\na = {1\n"), ("d.txt", "ENVI\n")):
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception, match="header"):
            headers.read_headers(spark, str(tmp_path / name)).collect()


def test_maps(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 0, 0.123456789), (2, 0, 1, 2.0)], "tile int, r int, c int, v double")
    maps.write_map(df, str(tmp_path / "m"), "tile")
    maps.write_map(df.filter("tile = 2").withColumn("v", F.lit(7.0)), str(tmp_path / "m"), "tile")
    assert sorted(r.v for r in spark.read.parquet(str(tmp_path / "m")).collect()) == [0.123456789, 7.0]
    maps.write_table(df, str(tmp_path / "t"))
    assert "0.12346" in "".join(p.read_text() for p in (tmp_path / "t").glob("part*"))
    long = maps.long_map(df, ["r", "c"], ["v"])
    assert sorted(map(tuple, maps.wide_map(long, ["r", "c"], ["v"]).collect())) == [(0, 0, 0.123456789), (0, 1, 2.0)]
    maps.compact(df, str(tmp_path / "k"), 1)
    px = maps.read_pixels(spark, str(tmp_path / "k"), ["v"], (0, 0))
    assert px.columns == ["r", "c", "v"] and maps.stack([px, px.withColumnRenamed("v", "w")]).columns == ["r", "c", "v", "w"]
    points = spark.createDataFrame([([1.0, 2.0], 0.5, "x")], "coord array<double>, a double, k string")
    assert tuple(maps.scatter_points(points, "a", "coord", "k").first()) == (1.0, 2.0, None, 0.5, "x")


def test_options():
    assert options.for_entry("tiles").iqr_weight == 4.0 and options.for_entry("full", window=5).window == 5
    with pytest.raises(options.WorkflowError):
        options.report("no_pca")
    with pytest.warns(UserWarning):
        options.report("few_pixels")
    with pytest.raises(options.WorkflowError):
        workflows.apply_tiles(None, "tile", 1, None, options.Options())


def test_tiled_is_untiled(spark):
    """Tiles whose height is a multiple of the window change nothing."""
    cells = [(r * 40 + c, r, c, r // 20, *map(float, RNG.normal(size=2))) for r in range(40) for c in range(40)]
    df = spark.createDataFrame(cells, "i bigint, r bigint, c bigint, tile bigint, a double, b double")
    opts = options.Options(window=10, n_clusters=5, n_iter=2, starts=1, alpha_sample=400, beta_sample=20, fd_metrics=("fric", "fdis"))
    model = workflows.fit(df, ["a", "b"], "i", opts)
    whole = workflows.transform(df.withColumn("win_id", windows.window_id(F.col("r"), F.col("c"), 10, 40)), model, ["win_id"], opts)
    tiled = workflows.apply_tiles(df, "tile", 40, model, opts)
    a, b = ({r.win_id: (round(r.shannon_mean, 9), round(r.fric, 9), [round(x, 6) for x in r.coord]) for r in x.collect()} for x in (whole, tiled))
    assert a == b and len(a) == 16


@given(st.lists(st.floats(-50, 50), min_size=4, max_size=40))
@settings(max_examples=30, deadline=None)
def test_rao_by_ranks(values):
    x = np.array(values)
    n = len(x)
    ranked = 2 * sum((2 * i - n - 1) * v for i, v in enumerate(sorted(values), 1)) / n**2
    assert math.isclose(functional.rao(x[:, None], 3), ranked, abs_tol=1e-9)


def test_continuum_variants_follow_the_plain_function(spark):
    """Every variant of the operator is the function's; a zero has no absorbance."""
    wl = [410.0, 420.0, 430.0, 440.0, 450.0, 460.0]
    spectra = {1: [1.0, 3.0, 2.0, 4.0, 2.0, 1.0], 2: [0.0, 3.0, 2.0, 4.0, 2.0, 1.0]}
    rows = spark.createDataFrame(list(spectra.items()), "i int, s array<double>")
    for kind in ({"absorbance": True}, {"subtract": True}, {"spline": True}, {"subtract": True, "spline": True}):
        got = {r.i: r.cr for r in transforms.continuum_removed(rows, wl, "i", "s", **kind).collect()}
        for i, s in spectra.items():
            whole = transforms.remove_continuum(np.array(s), np.array(wl), **kind)[1:-1] if i == 1 or "absorbance" not in kind else np.zeros(4)
            assert np.allclose(got[i], whole)


def test_forward_report_lists_every_candidate(spark):
    """The metric that chooses is one of several; a candidate without it is never preferred."""
    score = {"a": (0.9, 0.1), "b": (0.2, 0.5), "c": (0.3, None)}

    def criterion(sets):
        rows = [(i, m, r) for i, s in enumerate(sets) for m, r in zip(("x", "y"), score[s[-1]], strict=True)]
        return spark.createDataFrame(rows, "candidate int, metric string, r double")

    got = search.forward_report(["a", "b", "c"], criterion, "y")
    assert [(step, f) for step, f, m, _, best in got if best and m == "y"] == [(1, "b"), (2, "a"), (3, "c")]
    assert len(got) == 2 * (3 + 2 + 1)


def test_tile_quotas_of_plots(spark):
    """Tiles share the plots by their size, rounded up; a tile with too few pixels around gives none."""
    pixels = spark.createDataFrame([(r * 30 + c, r, c, 0 if c < 20 else 1) for r in range(30) for c in range(30)] + [(5000, 90, 90, 2)], "id long, r long, c long, t int")
    alpha, beta = sampling.sample_all_tiles(pixels, "t", "id", 90, 9, 3)
    assert {r.t: r["count"] for r in alpha.groupBy("t").count().collect()} == {0: 60, 1: 30}
    plots = beta.select("t", "plot_id").distinct().collect()
    assert sorted(r.plot_id for r in plots) == list(range(1, len(plots) + 1))
    assert sorted(r.t for r in plots) == [0] * 6 + [1] * 3
