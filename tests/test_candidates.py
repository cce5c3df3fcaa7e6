"""What a forward selection does for each candidate."""

from collections import Counter

import numpy as np

from plotweave.operators.species import SpeciesModel, fit_species, several_counts


def test_bounds_of_a_fit_are_local(spark):
    sample = spark.range(300).selectExpr("id", "cast(id % 17 as double) as a", "cast(id % 5 as double) as b")
    model = fit_species(sample, ["a", "b"], "id", 2, 3, starts=1)
    plan = model.bounds._jdf.queryExecution().executedPlan().toString()
    # Quartiles were made for the fit; who scales by them doesn't make them again.
    assert "Aggregate" not in plan and "Exchange" not in plan
    assert {r.band for r in model.bounds.collect()} == {"a", "b"}


def test_counts_of_candidates(spark):
    rng = np.random.default_rng(3)
    rows = [(None if i % 7 == 0 else int(rng.integers(4)), f"s{i % 2}", float(rng.random()), None if i % 11 == 0 else float(rng.random())) for i in range(400)]
    frame = spark.createDataFrame(rows, "plot bigint, side string, a double, b double")

    def model(bands, sets):
        centroids = spark.createDataFrame([(i + 1, c + 1, list(map(float, x)), 0.0) for i, s in enumerate(sets) for c, x in enumerate(s)], "iter int, cid int, center array<double>, cost double")
        return SpeciesModel(centroids, spark.createDataFrame([(b, 0.0, 1.0) for b in bands], "band string, low double, high double"), bands)

    sets = {("a",): [[[0.2], [0.7]], [[0.1], [0.5], [0.9]]], ("a", "b"): [[[0.2, 0.2], [0.8, 0.5]], [[0.5, 0.1], [0.5, 0.9]]]}
    got = {(r.candidate, r.plot, r.side, r.iter, r.cid): r.n for r in several_counts(frame, [model(b, s) for b, s in sets.items()], ["plot", "side"]).collect()}
    want: Counter = Counter()
    for plot, side, a, b in rows:
        for i, (bands, its) in enumerate(sets.items()):
            x = [a, b][: len(bands)]
            if None not in x:
                for it, s in enumerate(its):
                    want[i, plot, side, it + 1, 1 + int(np.argmin([sum((u - v) ** 2 for u, v in zip(c, x, strict=True)) for c in s]))] += 1
    assert got == dict(want)
