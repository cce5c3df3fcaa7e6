"""k-means by single transfers: optimal, and never worse than Lloyd's from the same start."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotweave.operators import species


def sum_of_squares(points, at):
    return sum(((points[at == c] - points[at == c].mean(0)) ** 2).sum() for c in np.unique(at))


@pytest.mark.parametrize("seed", range(12))
def test_no_single_transfer_improves(seed):
    rng = np.random.default_rng(seed)
    points = rng.normal(0, 1, (120, 3)) + 2 * rng.integers(0, 3, (120, 1))
    k = int(rng.integers(2, 9))
    start = species.spread_start(points, k, np.random.default_rng(seed))
    centers = species.transfer_steps(points, start, 50)
    at = species.nearest(points, centers)[0]
    cost = sum_of_squares(points, at)
    assert cost <= species.nearest(points, species.lloyd_steps(points, start, 50))[1].sum() * (1 + 1e-9)
    for i in range(len(points)):
        if (at == at[i]).sum() > 1:
            for c in set(range(k)) - {at[i]}:
                moved = at.copy()
                moved[i] = c
                assert sum_of_squares(points, moved) >= cost * (1 - 1e-9)


def test_finds_what_lloyd_cannot():
    """Points on a line where means stay put but a transfer pays."""
    better = 0
    for seed in range(30):
        rng = np.random.default_rng(seed)
        points = rng.normal(0, 1, (60, 4))
        start = points[:6]
        ours = species.nearest(points, species.transfer_steps(points, start, 50))[1].sum()
        lloyd = species.nearest(points, species.lloyd_steps(points, start, 50))[1].sum()
        assert ours <= lloyd * (1 + 1e-9)
        better += ours < lloyd * (1 - 1e-6)
    assert better > 10


def test_repeated_points_and_more_clusters_than_points():
    points = np.array([[0.0, 0.0]] * 5 + [[1.0, 1.0]] * 3)
    centers, cost = species.kmeans(points, 4, 2, 50, 0)
    assert len(centers) == 4 and cost == pytest.approx(0)
    assert len(species.kmeans(points[:1], 3, 2, 50, 0)[0]) == 1


def test_check_tells_a_bad_model(spark):
    points = spark.createDataFrame([(i, [float(i), 0.0], 1) for i in range(10)], "id bigint, x array<double>, iter int")
    bad = spark.createDataFrame([(1, 1, [0.0, 0.0]), (1, 2, [1.0, 0.0])], "iter int, cid int, center array<double>")
    found = species.transfer_check(points, bad, "x", "id").collect()
    assert {r.id for r in found if r.centred} == {0} and len(found) == 10
    good = spark.createDataFrame([(1, 1, [2.0, 0.0]), (1, 2, [7.0, 0.0])], "iter int, cid int, center array<double>")
    assert {(r.clusters, r.improvable, r.centred) for r in species.transfer_check(points, good, "x", "id").collect()} == {(2, False, True)}


def test_algorithms(spark):
    rows = spark.range(80).select(F.col("id"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"), F.lit(1).alias("lot"))
    cost = {name: species.fit_lots(rows, ["a", "b"], "lot", (5,), 3, algorithm=name).first().cost for name in species.ALGORITHMS}
    assert cost["hartigan-wong"] <= cost["lloyd"]
    with pytest.raises(ValueError, match="algorithm"):
        species.fit_lots(rows, ["a", "b"], "lot", algorithm="other")
