"""Functional metrics of many windows side by side."""

import numpy as np
import pytest

from plotweave.operators import functional


def naive_tree(points):
    """Edge lengths of the spanning tree, all pairs sorted (Kruskal)."""
    root = list(range(len(points)))

    def find(i):
        return i if root[i] == i else find(root[i])

    out = []
    for gap, i, j in sorted((float(np.linalg.norm(points[i] - points[j])), i, j) for i in range(len(points)) for j in range(i)):
        if find(i) != find(j):
            root[find(i)] = find(j)
            out.append(gap)
    return out


@pytest.mark.parametrize("d", [1, 2, 3, 4])
def test_windows_together_as_alone(d):
    rng = np.random.default_rng(d)
    made = (rng.normal(size=(n, d)) if n % 3 else rng.integers(0, 3, (n, d)).astype(float) for n in (1, 30, 2, 12, 5, 6, 31, 9, 3, 40))
    windows = [*made, np.ones((7, d)), np.zeros((0, d))]
    assert functional.metrics_of_windows(windows, functional.METRICS) == [pytest.approx(functional.metrics_of(w, functional.METRICS)) for w in windows]
    for points, edges in zip(windows, functional.spanning_trees(windows), strict=True):
        assert np.allclose(sorted(edges), naive_tree(points))
    for points, found in zip(windows[:-1], functional.hulls(windows[:-1]), strict=True):
        if found is not None:
            # No facet of the vertices' own hull is seen from a point.
            assert functional.hull(points[found[0]])[1] == pytest.approx(found[1])
            assert functional.hull(np.vstack([points, points.mean(0)]))[1] == pytest.approx(found[1])


def test_steps_do_not_grow_with_windows(monkeypatch):
    calls = []
    real = np.cross
    monkeypatch.setattr(np, "cross", lambda *a, **b: calls.append(1) or real(*a, **b))
    rng = np.random.default_rng(0)
    windows = [rng.random((30, 3)) for _ in range(200)]
    functional.metrics_of_windows(windows, functional.METRICS)
    # As many as the window with the most steps has, not as many as all have.
    assert len(calls) <= 30
