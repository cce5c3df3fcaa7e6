"""Ball k-means against Lloyd's algorithm in plain integers."""

import hashlib
import math

import numpy as np
import pytest

from plotweave.llm import ball_kmeans


def lloyd(rows, k, rounds, units, seed):
    """(identifier, vector) to (identifier, vector, cluster, distance), with the centroids."""
    whole = [(i, [math.floor(units * float(x)) for x in v]) for i, v in rows]
    order = sorted(whole, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for step in range(rounds + 1):
        chosen = [min((apart(v, c), j) for j, c in enumerate(centres)) for _, v in whole]
        if step < rounds:
            for j in range(len(centres)):
                own = [v for (_, v), (_, i) in zip(whole, chosen, strict=True) if i == j]
                if own:
                    centres[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return [(i, j, d) for (i, _), (d, j) in zip(whole, chosen, strict=True)], centres


@pytest.mark.parametrize("scale", [1.0, 100_000.0])
def test_equals_lloyd(spark, scale):
    rng = np.random.default_rng(4)
    middle = rng.normal(0, 1, (6, 5))
    rows = [(i, (scale * (middle[i % 6] + rng.normal(0, 0.4, 5))).tolist()) for i in range(300)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[3][1])] + [(400 + i, [scale] * 5) for i in range(40)]
    odd = [(900, None), (901, [1.0] * 4), (902, [1.0, None, 1.0, 1.0, 1.0]), (903, [float("nan")] * 5), (904, [float("inf")] * 5), (905, [])]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + odd], "vec_id bigint, embedding array<double>, cluster int, name string")
    found = ball_kmeans.cluster(table.repartition(5), clusters=12, rounds=4, dimensions=5)
    want, centres = lloyd(rows, 12, 4, ball_kmeans.UNITS, ball_kmeans.SEED)
    got = found.collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=key) == sorted(want, key=key)
    inertia = {}
    for _, j, d in want:
        inertia[j] = inertia.get(j, 0) + d
    assert {r.cluster: (r.cluster_inertia, r.centroid) for r in got} == {j: (t, centres[j]) for j, t in inertia.items()}
    assert {r.inertia for r in got} == {sum(inertia.values())}


def test_ties_go_to_the_smaller_number_and_empty_clusters_stay(spark):
    rows = [(i, [float(i % 3), 0.0]) for i in range(30)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = ball_kmeans.cluster(table, clusters=20, rounds=3, dimensions=2).collect()
    want, centres = lloyd(rows, 20, 3, ball_kmeans.UNITS, ball_kmeans.SEED)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == sorted(want)
    assert len({j for _, j, _ in want}) == 3


def test_stable_core_is_not_compared():
    centres = np.array([[0, 0], [100, 0], [1000, 0]], np.int64)
    balls = ball_kmeans.Balls(centres, [60.0, 60.0, 60.0])
    assert balls.neighbours == [[1], [0], []]
    cluster, distance = balls.assign(np.array([[10, 0], [50, 0], [51, 0], [950, 0]], np.int64), np.array([0, 0, 0, 2]))
    assert cluster.tolist() == [0, 0, 1, 2] and distance.tolist() == [100, 2500, 2401, 2500]


def test_few_none_and_too_large(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id bigint, embedding array<float>")
    assert [tuple(r)[:3] for r in ball_kmeans.cluster(table, dimensions=2).orderBy("vec_id").collect()] == [(1, 0, 0), (2, 0, 0)]
    assert ball_kmeans.cluster(table.limit(0), dimensions=2).collect() == []
    with pytest.raises(Exception, match="beyond"):
        ball_kmeans.cluster(table.selectExpr("vec_id", "array(1e30D, 1D) as embedding"), dimensions=2)
