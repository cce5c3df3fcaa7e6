"""A forward selection's species come from all pixels."""

from plotweave.plans import grid_queries, workflows
from tests.conftest import DATA


def test_species_are_fitted_on_all_pixels(spark, monkeypatch):
    seen, real = [], workflows.fit_species

    def fit(sample, bands, *args, **options):
        seen.append((tuple(bands), sample.count()))
        return real(sample, bands, *args, **options)

    monkeypatch.setattr(workflows, "fit_species", fit)
    rows = grid_queries.forward_selection(spark, f"{DATA}/sf0.01").collect()
    n = grid_queries.pixels(spark, f"{DATA}/sf0.01").count()
    assert [r.round for r in rows] == [1, 2] and len(seen) == 5
    assert n > 1000 and {size for _, size in seen} == {n}
