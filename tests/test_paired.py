"""Dissimilarities of any number of plots, in blocks, against all pairs listed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotweave.operators import beta, search
from plotweave.plans import grid_queries, workflows
from tests.conftest import DATA


@pytest.mark.parametrize("block", [3, 1024])
@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_equals_listed_pairs(spark, block, method):
    rng = np.random.default_rng(block)
    rows = [(p, it, int(c), float(n)) for p in range(25) for it in (1, 2, 3) for c, n in zip(range(1, 5), np.random.default_rng(p % 17 * 5 + it).integers(0, 4, 4) + (p % 17 == it), strict=True) if n]
    rows = [r for r in rows if r[:2] != (4, 1)] + [(p, it, 1, 1.0) for p, it in {(p, it) for p in range(25) for it in (1, 2, 3)} - {r[:2] for r in rows} - {(4, 1)}]
    counts = spark.createDataFrame(rows, "plot_id int, iter int, cid int, n double")
    seen = spark.createDataFrame([(p, f"t{c}", float(rng.integers(1, 4) if p != 7 else 2)) for p in range(24) for c in range(3)], "plot_id int, cid string, n double")
    shares, observed = beta.species_shares(counts, ["plot_id", "iter"]), beta.species_shares(seen, ["plot_id"])
    listed = beta.bray_curtis_pairs(shares, "plot_id", ["iter"])
    truth = beta.bray_curtis_pairs(observed, "plot_id")
    parts = [[1], [2, 3], [1, 2, 3]]
    found = search.paired(shares, parts, 4, observed, block).cache()
    got = {r.part: (r.n, r.r) for r in search.weighted_correlation(found, method, ["part"]).collect()}
    for i, its in enumerate(parts):
        r = search.mantel(beta.mean_over_iterations(listed.filter(F.col("iter").isin(its))), truth, method).first()
        assert got[i] == (r.n, pytest.approx(r.r, abs=1e-9))
    assert found.filter("part = 0").agg(F.sum("m")).first()[0] == 23 * 22 // 2


@pytest.mark.parametrize("name", ["forward_selection_report", "cluster_runs_kept", "cluster_search_beta"])
def test_more_plots_than_an_ordination_takes(spark, monkeypatch, name):
    monkeypatch.setattr(beta, "MAX_TRAINING", 2)
    assert grid_queries.QUERIES[name](spark, f"{DATA}/sf0.01").count() > 1


def test_shares_and_pairs_select_alike(spark):
    px, observed = grid_queries._blocks(spark, f"{DATA}/sf0.01")
    pairs = beta.bray_curtis_pairs(observed["bc"], "plot_id")
    options = workflows.Options(n_clusters=4, n_iter=2, starts=1)
    sample = px.filter("event_id % 10 = 0")
    one, two = ({r.candidate: r.r for r in workflows.feature_criterion(sample, px, x, "event_id", "bc", options)([["value"], ["k", "minute"]]).collect()} for x in (observed["bc"], pairs))
    assert one.keys() == two.keys() == {0, 1} and one == pytest.approx(two, abs=1e-9)
