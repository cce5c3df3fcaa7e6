"""The sample that masks of tiles are made from."""

from plotweave.operators import masks
from plotweave.plans import workflows
from plotweave.plans.bindings import BANDS, pixels
from plotweave.plans.grid_queries import portable
from plotweave.plans.model_queries import MASKED
from tests.conftest import DATA


def test_sample_is_ranked_once(spark, monkeypatch):
    seen = []
    real = masks.iqr_bounds
    monkeypatch.setattr(workflows, "iqr_bounds", lambda part, *a: seen.append(part) or real(part, *a))
    workflows.tile_masks(pixels(spark, f"{DATA}/sf0.001"), BANDS, "tile", "event_id", MASKED, 100, portable())
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    # Quartiles read it several times; the ranks behind it aren't made again.
    assert "Window" not in plan and "Exchange" not in plan


def test_bounds_of_tiles_are_those_of_all_pixels(spark, monkeypatch):
    px = pixels(spark, f"{DATA}/sf0.001")
    seen, whole = [], masks.iqr_bounds(px, BANDS, 0.4).collect()
    # No number of pixels from which on a sample stands for them.
    monkeypatch.setattr(workflows, "STATISTICS", 100, raising=False)
    monkeypatch.setattr(workflows.tile_masks, "__defaults__", tuple(100 if d == 5_000_000 else d for d in workflows.tile_masks.__defaults__))
    real = workflows.iqr_bounds
    monkeypatch.setattr(workflows, "iqr_bounds", lambda part, *a: seen.append(real(part, *a)) or seen[-1])
    workflows.tile_masks(px, BANDS, "tile", "event_id", MASKED)
    assert sorted(seen[0].collect()) == sorted(whole)


def test_a_sample_larger_than_the_pixels_is_all_of_them(spark):
    px = pixels(spark, f"{DATA}/sf0.001")
    kept = [sorted(r.event_id for r in workflows.tile_masks(px, BANDS, "tile", "event_id", MASKED, n).select("event_id").collect()) for n in (None, 10**6)]
    assert kept[0] == kept[1] and 0 < len(kept[0]) < px.count()
