"""Moving windows counted once, and windows placed a few at a time."""

import tracemalloc

import numpy as np

from plotweave.operators import beta
from plotweave.plans import model_queries
from tests.conftest import DATA


def test_moving_counts_are_made_once(spark):
    plan = model_queries.moving_model(spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # What is left in Python is the projection.
    assert plan.count("MapInPandas") == 1


def test_places_of_many_windows_take_little():
    rng = np.random.default_rng(1)
    windows, training, places = rng.random((6_000, 12)), rng.random((2_000, 12)), rng.random((2_000, 3))
    tracemalloc.start()
    found = beta.placed(windows, training, places, 3, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # All distances at once are 96 MB, with their order and copies several times that.
    assert peak < 90 << 20
    want = beta.nearest_places(beta.bray_curtis_matrix(windows[:50], training, 2), places, 3)
    assert np.allclose(found[:50], want) and len(found) == 6_000
    assert beta.placed(windows[:0], training, places, 3, 2).shape == (0, 3)
