"""Polygons against plain geometry."""

import random

import numpy as np
import pytest

from plotweave.operators import plots, polygons
from plotweave.plans import polygon_queries


def inside(rings, x, y):
    n = 0
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            n += (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1)
    return n % 2 == 1


def area(ring):
    return sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


@pytest.fixture(scope="module")
def shapes():
    rng = random.Random(4)
    out = dict(polygon_queries.POLYGONS)
    for k in range(10, 16):  # stars
        cx, cy = rng.uniform(10, 30), rng.uniform(10, 30)
        turns = sorted(rng.uniform(0, 6.28) for _ in range(9))
        reach = [rng.uniform(2, 12) for _ in turns]
        out[k] = [[(round(float(cx + s * np.cos(t)), 2), round(float(cy + s * np.sin(t)), 2)) for s, t in zip(reach, turns, strict=True)]]
    out[20] = [[(3.0, 3.0), (8.0, 3.0), (8.0, 8.0), (3.0, 8.0), (3.0, 3.0)]]  # closed, edges on pixels
    out[21] = [[(5.2, 5.2), (5.4, 5.2), (5.4, 5.4)]]  # between pixels
    return out


def test_pixels_inside(spark, shapes):
    rows = [(r, c, 1.0) for r in range(45) for c in range(0, 105)]
    px = spark.createDataFrame(rows, "r int, c int, v double")
    frame = spark.createDataFrame(list(shapes.items()), polygon_queries.RING_KIND)
    for span in (7, polygons.SPAN):
        got = {(x.plot_id, x.r, x.c) for x in polygons.pixels_inside(px, frame, span).collect()}
        assert got == {(k, r, c) for k, rings in shapes.items() for r, c, _ in rows if inside(rings, c, r)}
    assert {(r, c) for k, r, c in got if k == 20} == {(r, c) for r in range(3, 8) for c in range(3, 8)} and 21 not in {k for k, *_ in got}


def test_shares_sum_to_the_area(spark, shapes):
    frame = spark.createDataFrame(list(shapes.items()), polygon_queries.RING_KIND)
    found = polygons.covered_cells(frame, 4, top=-1.5, left=0.5).collect()
    for k, rings in shapes.items():
        assert sum(x.share for x in found if x.plot_id == k) * 16 == pytest.approx(abs(sum(map(area, rings))), rel=1e-9)
    assert all(0 < x.share <= 1 + 1e-9 for x in found)
    # A cell's share by a fine grid of its points.
    fine = [(i + 0.5) / 60 for i in range(60)]
    for x in found[::7]:
        rings = shapes[x.plot_id]
        hits = np.mean([inside(rings, 0.5 + 4 * (x.cell_c + a), -1.5 + 4 * (x.cell_r + b)) for a in fine for b in fine])
        assert hits == pytest.approx(x.share, abs=0.03)


def test_random_points(spark, shapes):
    frame = spark.createDataFrame(list(shapes.items()), polygon_queries.RING_KIND)
    found = polygons.random_points(frame, 400, 1).collect()
    assert len(found) == 400 * len(shapes)
    for k, rings in shapes.items():
        own = [(x.x, x.y) for x in found if x.plot_id == k]
        assert len(set(own)) == 400 and np.mean([inside(rings, x, y) for x, y in own]) >= 0.995  # on an edge rounding decides
    # Evenly: parts get points in proportion to their areas, and the mean is the centre.
    one = [x for x in found if x.plot_id == 1]
    total = abs(sum(map(area, shapes[1])))
    assert np.mean([x.x >= 50 for x in one]) == pytest.approx(abs(area(shapes[1][2])) / total, abs=0.08)
    square = [x for x in found if x.plot_id == 20]
    assert np.mean([x.x for x in square]) == pytest.approx(5.5, abs=0.3) and np.mean([x.y for x in square]) == pytest.approx(5.5, abs=0.3)
    again = polygons.random_points(frame.repartition(5), 400, 1).collect()
    assert {tuple(x) for x in again} == {tuple(x) for x in found}
    assert {tuple(x) for x in polygons.random_points(frame, 10, 2).collect()}.isdisjoint({tuple(x) for x in found})


def test_layers_are_numbered_on(spark):
    layer = lambda ids: spark.createDataFrame([(i,) for i in ids], "local_id bigint")
    got = plots.numbered([("a", layer([5, 3, 9])), ("b", layer([])), ("c", layer([2, 1]))]).collect()
    assert sorted((x.plot_id, x.source, x.local_id) for x in got) == [(1, "a", 3), (2, "a", 5), (3, "a", 9), (4, "c", 1), (5, "c", 2)]
