"""Training plots over the bound aren't left out in silence."""

from types import SimpleNamespace

import pytest

from plotweave.operators import beta
from plotweave.plans import workflows


def test_too_many_training_plots_raise(spark, monkeypatch):
    monkeypatch.setattr(beta, "MAX_TRAINING", 3)
    shares = spark.createDataFrame([(i, [1.0]) for i in range(4)], "plot_id bigint, ssd array<double>")
    monkeypatch.setattr(workflows, "assign_model", lambda *_: None)
    monkeypatch.setattr(workflows.alpha_ops, "iteration_counts", lambda *_: None)
    monkeypatch.setattr(workflows, "stacked_shares", lambda *_: shares)
    with pytest.raises(ValueError, match="training plots"):
        workflows.fit_beta(None, None, SimpleNamespace(n_clusters=1, n_iter=1, pcelim=0.0, dimensions=1))
