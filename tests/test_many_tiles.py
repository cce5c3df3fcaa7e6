"""Workflows over more tiles than pixels or plots are wanted of."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotweave.operators import beta, ordination, sampling
from plotweave.plans import workflows
from plotweave.plans.bindings import BANDS, N_COLS, pixels
from plotweave.plans.grid_queries import SMALL
from tests.conftest import DATA


def test_more_tiles_than_pixels_wanted(spark):
    px = spark.range(400).select(F.col("id"), (F.col("id") % 40).alias("t"), (F.col("id") / 40).cast("int").alias("r"), (F.col("id") % 40).alias("c"))
    sample, _ = sampling.sample_all_tiles(px, "t", "id", 9, 5, 1, carried=True)
    assert sample.count() == 9


def test_coordinates_without_a_matrix(spark):
    rng = np.random.default_rng(2)
    training = rng.dirichlet([0.4] * 5, 2 * 70).reshape(70, 10)
    want = ordination.principal_coordinates(beta.bray_curtis_matrix(training, training, 2), 3)[0]
    assert ordination.spread_coordinates(spark, training, 2, 3) == pytest.approx(want, abs=1e-9)
    # Two places only, so there is one axis.
    twice = np.repeat(training[:2], 20, 0)
    want = ordination.principal_coordinates(beta.bray_curtis_matrix(twice, twice, 2), 3)[0]
    got = ordination.spread_coordinates(spark, twice, 2, 3)
    assert got.shape == want.shape and got == pytest.approx(want, abs=1e-9)


def test_workflow_of_many_tiles(spark, monkeypatch):
    px = pixels(spark, f"{DATA}/sf0.001").withColumn("tile", F.floor(F.col("r") / 5) * 20 + F.floor(F.col("c") / 5))
    options = replace(SMALL, alpha_sample=19, beta_sample=60, n_clusters=2, window=2, alpha_metrics=("shannon",))
    run = lambda: {(r.tile, r.win_id): (r.shannon_mean, r.coord) for r in workflows.tiled_diversity(px, BANDS, "tile", "event_id", N_COLS, options).collect()}
    want = run()
    monkeypatch.setattr(beta, "MAX_TRAINING", 20)
    got = run()
    assert want.keys() == got.keys() and len(want) > 100
    for k, (shannon, coord) in want.items():
        assert got[k][0] == shannon and got[k][1] == pytest.approx(coord, abs=1e-6)
