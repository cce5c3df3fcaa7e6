"""Components of whole spectra: the chain from bands to scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotweave.operators import ordination
from plotweave.plans import workflows
from plotweave.plans.bindings import WAVELENGTHS, spectra
from plotweave.plans.options import WorkflowError
from tests.conftest import DATA


def test_moments_of_arrays(spark):
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(200, 20)) + 1e6
    frame = spark.createDataFrame([(r.tolist(),) for r in rows] + [([float("nan")] * 20,), (None,)], "x array<double>").repartition(5)
    n, mean, covariance = ordination.array_moments(frame, "x")
    assert n == 200 and np.allclose(mean, rows.mean(0)) and np.allclose(covariance, np.cov(rows.T), atol=1e-8)
    wide = frame.select(*(F.get("x", F.lit(k)).alias(f"b{k}") for k in range(20)))
    assert np.allclose(ordination.moments(wide, [f"b{k}" for k in range(20)])[2], covariance)
    assert ordination.array_moments(frame.filter("false"), "x")[0] == 0


def test_scores_have_the_variances_of_their_components(spark):
    own = spectra(spark, f"{DATA}/sf0.001")
    model = workflows.fit_components(own, WAVELENGTHS, "vec_id", "x", keep=5)
    scores = workflows.components(own, model, "vec_id", "x").toPandas()
    found = np.cov(scores[[f"pc{k}" for k in range(1, 6)]].to_numpy().T)
    assert len(scores) == own.count() and np.allclose(found, np.diag(model.rotation.variance), atol=1e-6)
    assert list(model.rotation.variance) == sorted(model.rotation.variance, reverse=True)
    plain = workflows.fit_components(own, WAVELENGTHS, "vec_id", "x", standardize=False, continuum=False, selected=[1, 3])
    assert workflows.components(own, plain, "vec_id", "x").columns == ["vec_id", "pc1", "pc3"] and plain.chosen() == (1, 3)


def test_named_faults(spark):
    own = spectra(spark, f"{DATA}/sf0.001")
    with pytest.raises(WorkflowError, match="principal components"):
        workflows.components(own, None, "vec_id", "x")
    with pytest.raises(WorkflowError, match="chosen"):
        workflows.fit_components(own, WAVELENGTHS, "vec_id", "x", keep=2).chosen()
