"""k-means of lots that no task holds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotweave.operators import species


@pytest.mark.parametrize("rows,active", [(40, 8), (40, 8192)])
def test_large_lots_are_optimal(spark, monkeypatch, rows, active):
    monkeypatch.setattr(species, "LOT_ROWS", 100)
    monkeypatch.setattr(species, "START_ROWS", rows)
    monkeypatch.setattr(species, "ACTIVE", active)
    points = spark.range(600).select(F.col("id"), ((F.col("id") % 3 + 1).cast("int") % 2 + 1).alias("iter"), F.array(*(F.rand(7 + i) for i in range(3))).alias("x"))
    points = spark.createDataFrame(points.collect(), points.schema)
    flat = points.select("iter", *(F.col("x")[i].alias(f"b{i}") for i in range(3)))
    fitted = species.fit_lots(flat, ["b0", "b1", "b2"], "iter", (5,), 2).cache()
    assert {(r.k, r.iter, r.cid) for r in fitted.collect()} == {(5, it, c) for it in (1, 2) for c in range(1, 6)}
    found = species.transfer_check(points, fitted, "x", "id").collect()
    assert {(r.clusters, r.improvable, r.centred) for r in found} == {(5, False, True)} and len(found) == 600
    for it in (1, 2):
        own = np.array([r.x for r in points.collect() if r.iter == it])
        centers = np.array([r.center for r in fitted.orderBy("cid").collect() if r.iter == it])
        cost = next(r.cost for r in fitted.collect() if r.iter == it)
        assert cost == pytest.approx(species.nearest(own, centers)[1].sum())
        assert cost <= 1.1 * species.kmeans(own, 5, 2, 50, it)[1]
