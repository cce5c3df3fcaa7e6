"""The ways that large tables take, forced on small ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotweave.functions.names import without_extension
from plotweave.operators import beta, masks, ordination, sampling, species
from plotweave.plans import model_queries, workflows
from plotweave.plans.bindings import BANDS, pixels
from plotweave.plans.options import Options
from tests.conftest import DATA


@pytest.mark.parametrize("small", [masks.SMALL, 2000])
def test_quartiles_through_a_narrow_range(spark, monkeypatch, small):
    monkeypatch.setattr(masks, "SMALL", small)
    monkeypatch.setattr(masks, "ACCURACY", 1 << 10)
    rng = np.random.default_rng(3)
    rows = [(int(t), float(a), float(b)) for t, a, b in zip(rng.choice([0, 0, 0, 1], 20_000), rng.normal(size=20_000), rng.integers(0, 5, 20_000), strict=True)]
    rows += [(2, float("nan"), 1.0), (2, None, 2.0), (None, 1.0, float("inf"))]
    frame = spark.createDataFrame(rows, "t int, a double, b double")
    got = {(r.t, r.band): (r.q1, r.q3) for r in masks.quartiles(frame, ["a", "b"], ["t"]).collect()}
    for t in (0, 1):
        for k, band in ((1, "a"), (2, "b")):
            want = np.percentile([r[k] for r in rows if r[0] == t], [25, 75])
            assert np.allclose(got[t, band], want, rtol=1e-12)
    assert got[2, "a"] == (None, None) and got[2, "b"] == (1.25, 1.75) and got[None, "b"] == (None, None) and got[None, "a"] == (1.0, 1.0)
    assert masks.quartiles(frame.filter("false"), ["a"]).collect() == []
    assert masks.within(frame.filter("false"), masks.iqr_bounds(frame.filter("false"), ["a"]), ["a"]).collect() == []


@pytest.mark.parametrize("ranges", [2, 7, 16])
def test_ranks_from_ranges(spark, monkeypatch, ranges):
    monkeypatch.setattr(sampling, "STEPS", ranges)
    rows = [(k % 3, k, k * 7919 % 101) for k in range(500)] + [(9, -1, 5)]
    got = {r.key: (r._i, r._n) for r in sampling.ranked(spark.createDataFrame(rows, "tile int, key bigint, o bigint"), "tile", F.col("o"), "key").collect()}
    for t in (0, 1, 2, 9):
        own = sorted((o, k) for tile, k, o in rows if tile == t)
        assert all(got[k] == (i + 1, len(own)) for i, (_, k) in enumerate(own))


def test_bounds_of_bounded_tables_raise(spark, monkeypatch):
    monkeypatch.setattr(beta, "MAX_TRAINING", 3)
    monkeypatch.setattr(ordination, "MAX_TRAINING", 3)
    monkeypatch.setattr(species, "MAX_CENTROIDS", 3)
    shares = spark.createDataFrame([(k, "a", 1.0) for k in range(4)], "site int, cid string, p double")
    training = shares.withColumnRenamed("site", "train_id")
    pairs = spark.createDataFrame([(0, 1, 0.5)], "a int, b int, bc double")
    for call in (lambda: beta.bray_curtis_pairs(shares, "site"), lambda: ordination.ordinate(pairs, shares, "site"), lambda: beta.project_shares(shares, training, training, "site", []), lambda: species.assign_native(shares, shares, "p", "site")):
        with pytest.raises(ValueError, match="more than 3"):
            call()


def test_places_by_shares_are_those_by_pairs(spark):
    rng = np.random.default_rng(4)
    rows = []
    for site in range(12):
        p = rng.dirichlet(np.ones(4))
        rows += [(site, f"s{c}", float(x)) for c, x in zip(rng.choice(7, 4, replace=False), p, strict=True)]
    shares = spark.createDataFrame(rows, "site int, cid string, p double")
    training = shares.filter("site < 5").withColumnRenamed("site", "train_id")
    places = spark.createDataFrame([(k, float(k), float(k * k)) for k in range(5)], "train_id int, x double, y double")
    one = {r.site: (r.x, r.y) for r in beta.project_shares(shares, training, places, "site", ["x", "y"]).collect()}
    other = {r.site: (r.x, r.y) for r in beta.weighted_neighbours(beta.bray_curtis_to(shares, training, "site"), places, "site", ["x", "y"]).collect()}
    assert set(one) == set(other) and all(np.allclose(one[k], other[k]) for k in one)


def test_moving_window_option(spark):
    """``diversity`` heeds the option: a row a pixel, functional metrics of neighbourhoods too; tiles don't go with it."""
    px = pixels(spark, f"{DATA}/sf0.001").filter("r < 4 and c < 12")
    options = Options(window=3, n_clusters=3, n_iter=2, alpha_metrics=("richness",), fd_metrics=("fdis",), alpha_sample=40, beta_sample=8, starts=1, moving_window=True)
    rows = workflows.diversity(px, BANDS, "event_id", 100, options).collect()
    assert len(rows) == px.count() and {len(r.coord) for r in rows} != {0} and all(r.richness_mean >= 1 and r.fdis >= 0 for r in rows)
    with pytest.raises(ValueError, match="tiles"):
        workflows.evaluate(px, workflows.Model(model_queries.species(spark), None), 100, options, "tile")


def test_places_of_windows_by_classes(spark):
    """With all windows in the sample each is its own neighbour, and distances follow the dissimilarities."""
    rows = [(w, c, k) for w in range(6) for c, n in (("a", w), ("b", 6 - w), ("c", 1)) for k in range(n)]
    frame = spark.createDataFrame(rows, "win_id int, cls string, k int")
    found = {r.win_id: np.array(r.coord) for r in workflows.class_beta(frame, "cls", ["win_id"], Options(window=1, pcelim=0.0)).collect()}
    gaps = [np.linalg.norm(found[0] - found[w]) for w in range(6)]
    assert len(found) == 6 and gaps == sorted(gaps) and gaps[1] > 0
    assert workflows.class_beta(frame.filter("false"), "cls", ["win_id"], Options(window=1)).collect() == []


def test_names_that_keep_their_extension(spark):
    names = {"x.c": "x.c", ".hidden": ".hidden", "ab.c": "ab", "/d/x.c": "/d/x", "scene.tar.gz": "scene.tar"}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", without_extension(F.col("n")).alias("s")).collect()
    assert {r.n: r.s for r in got} == names


def build_sides(df):
    """The leaves below each broadcast of a plan."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-*(0123456789)"))
    out = []
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = []
            for other in lines[k + 1 :]:
                if depth(other) <= depth(line):
                    break
                below.append(other)
            out.append(" ".join(below))
    return out


def test_build_sides_are_small(spark):
    """What is broadcast are local rows, never a scan of pixels."""
    px = pixels(spark, f"{DATA}/sf0.01")
    for found in (masks.iqr_bounds(px, BANDS), sampling.sample_tiles(px, "tile", 300, "event_id"), sampling.sample_fraction(px, "tile", 0.25, "event_id")):
        sides = build_sides(found)
        assert sides and all(("LocalTableScan" in s or "ExistingRDD" in s) and "Scan parquet" not in s for s in sides)
