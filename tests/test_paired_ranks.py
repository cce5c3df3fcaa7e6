"""Rank correlations of pairs of plots from sums of blocks, against all pairs counted."""

import numpy as np
import pytest

from plotweave.operators import beta, search
from plotweave.plans import grid_queries, workflows
from tests.conftest import DATA


@pytest.mark.parametrize("block", [4, 1024])
def test_equals_counted_pairs(spark, block):
    rng = np.random.default_rng(1)
    counts = spark.createDataFrame([(p, it, c, float(rng.integers(1, 4))) for p in range(23) for it in (1, 2) for c in (1, 2, 3) if (p, it) != (4, 1)], "plot_id int, iter int, cid int, n double")
    seen = spark.createDataFrame([(p, f"t{c}", float(rng.integers(1, 4))) for p in range(22) for c in range(3)], "plot_id int, cid string, n double")
    shares, observed = beta.species_shares(counts, ["plot_id", "iter"]), beta.species_shares(seen, ["plot_id"])
    parts = [[1], [1, 2]]
    want = {r.part: (r.n, r.r) for r in search.weighted_correlation(search.paired(shares, parts, 3, observed, block), "spearman", ["part"]).collect()}
    got = {r.part: (r.n, r.r) for r in search.paired_ranks(shares, parts, 3, observed, block).collect()}
    assert got.keys() == want.keys() == {0, 1}
    for part, (n, r) in want.items():
        assert got[part] == (n, pytest.approx(r, abs=1e-9))


def test_selection_lists_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(workflows, "paired", lambda *_: pytest.fail("pairs are listed"))
    assert grid_queries.forward_selection_report(spark, f"{DATA}/sf0.001").count() > 1
