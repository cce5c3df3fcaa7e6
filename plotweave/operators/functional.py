"""Functional diversity of the pixels of a window: every pixel is a species with equal weight.

Richness is the volume of the convex hull of the traits, divergence and evenness follow
Villeger, Mason and Mouillot (2008), dispersion is the mean distance to the centroid and Rao's
quadratic entropy the mean distance between two pixels.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("fric", "feve", "fdiv", "fdis", "raoq")
#: Points whose windows are measured together, about; distances of a step of spanning trees.
LOT_POINTS, TREE_CELLS = 1 << 15, 1 << 14


def hull(points: np.ndarray) -> tuple[list[int], float] | None:
    """Vertices and volume of the convex hull in one or more dimensions; None where it is flat."""
    return hulls([points])[0]


def hulls(windows: Sequence[np.ndarray]) -> list[tuple[list[int], float] | None]:
    """``hull`` of many windows of equal dimensions, side by side.

    Points are added one by one: facets that a point sees are replaced by those that join it to the ridges around them. A step adds a
    point to every window that has one outside, and works on all of them as arrays; which point sees which facet is kept from step to step.
    """
    out: list[tuple[list[int], float] | None] = [None] * len(windows)
    if not windows:
        return out
    d = windows[0].shape[1]
    if d == 1:
        for w, points in enumerate(windows):
            low, high = int(points[:, 0].argmin()), int(points[:, 0].argmax())
            spread = float(points[high, 0] - points[low, 0])
            out[w] = (sorted({low, high}), spread) if spread > 0 else None
        return out
    sizes = [float(np.ptp(p, axis=0).max()) if len(p) else 0.0 for p in windows]
    simplices = [_first_simplex(p, 1e-10 * size) for p, size in zip(windows, sizes, strict=True)]
    solid = [w for w, simplex in enumerate(simplices) if simplex is not None]
    if not solid:
        return out
    points = np.concatenate([windows[w] for w in solid])
    lengths = np.array([len(windows[w]) for w in solid])
    firsts = np.cumsum(lengths) - lengths
    of, n = np.repeat(np.arange(len(solid)), lengths), len(solid)
    tolerance = np.array([1e-12 * sizes[w] for w in solid])
    inner = np.stack([windows[w][simplices[w]].mean(0) for w in solid])

    def planes(faces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Outward normals and offsets of facets: the last right singular vectors of their edges."""
        base, within = points[faces], inner[of[faces[:, 0]]]
        edges = base[:, 1:] - base[:, :1]
        normal = np.cross(edges[:, 0], edges[:, 1]) if d == 3 else np.linalg.svd(edges)[2][:, -1]
        normal = normal / np.maximum(np.linalg.norm(normal, axis=1, keepdims=True), 1e-300)
        offset = (normal * base[:, 0]).sum(1)
        flip = np.where((normal * within).sum(1) <= offset, 1.0, -1.0)
        return normal * flip[:, None], offset * flip

    def seen(left: np.ndarray, faces: np.ndarray, normals: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a point of ``left`` and a place in ``faces`` (in the order of windows) that it sees."""
        count = np.bincount(of[faces[:, 0]], minlength=n)
        start, own = np.cumsum(count) - count, of[left]
        each = count[own]
        p = np.repeat(left, each)
        f = np.repeat(start[own] - (np.cumsum(each) - each), each) + np.arange(len(p))
        sees = (points[p] * normals[f]).sum(1) > offsets[f] + tolerance[of[p]]
        return p[sees], f[sees]

    chosen = [sorted(simplices[w]) for w in solid]
    facets = np.array([f for first, simplex in zip(firsts, chosen, strict=True) for f in combinations((first + np.array(simplex)).tolist(), d)])
    dead = np.zeros(len(facets), bool)
    rest = np.ones(len(points), bool)
    rest[np.concatenate([first + np.array(simplex) for first, simplex in zip(firsts, chosen, strict=True)])] = False
    # Far points first: most others are then inside, and are passed over together.
    order = np.lexsort((-((points - inner[of]) ** 2).sum(1), of))
    rank = np.empty(len(points), np.int64)
    rank[order] = np.arange(len(points))
    point, facet = seen(np.flatnonzero(rest), facets, *planes(facets))
    while len(point):
        least = np.full(n, len(points))
        np.minimum.at(least, of[point], rank[point])
        now = rank[point] == least[of[point]]
        gone = facet[now]
        dead[gone] = True
        ridges = np.concatenate([np.delete(facets[gone], k, 1) for k in range(d)])
        ridges = ridges[np.lexsort(ridges.T[::-1])]
        new = np.append(True, (ridges[1:] != ridges[:-1]).any(1))
        ridges = ridges[new & np.append(new[1:], True)]  # those of one of the facets only
        faces = np.sort(np.column_stack([ridges, order[least[of[ridges[:, 0]]]]]), 1)
        more = seen(np.unique(point[~now]), faces, *planes(faces))
        stay = ~dead[facet]
        point, facet = np.append(point[stay], more[0]), np.append(facet[stay], more[1] + len(facets))
        facets, dead = np.concatenate([facets, faces]), np.append(dead, np.zeros(len(faces), bool))
    facets = facets[~dead]
    own = of[facets[:, 0]]
    volumes = np.bincount(own, np.abs(np.linalg.det(points[facets] - inner[own][:, None])), n) / factorial(d)
    vertices = np.unique(facets)
    for k, held in enumerate(np.split(vertices, np.searchsorted(vertices, firsts[1:]))):
        out[solid[k]] = ((held - firsts[k]).tolist(), float(volumes[k]))
    return out


def _first_simplex(points: np.ndarray, tolerance: float) -> list[int] | None:
    """``d + 1`` points that span the space, each the furthest from the span of those before."""
    chosen = [int(points[:, 0].argmin())] if len(points) else []
    rest = points - points[chosen[0]] if chosen else points
    while chosen and len(chosen) <= points.shape[1]:
        distance = (rest * rest).sum(1)
        at = int(distance.argmax())
        if distance[at] ** 0.5 <= tolerance:
            return None
        chosen.append(at)
        axis = rest[at] / distance[at] ** 0.5
        rest = rest - np.outer(rest @ axis, axis)
    return chosen or None


def spanning_tree(points: np.ndarray) -> np.ndarray:
    """Edge lengths of the minimum spanning tree."""
    return spanning_trees([points])[0]


def spanning_trees(windows: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Edge lengths of each window's minimum spanning tree (Prim); windows of like sizes get their next points together."""
    sizes = np.array([len(p) for p in windows], int)
    order, out, start = np.argsort(-sizes, kind="stable"), [np.zeros(0)] * len(windows), 0
    while start < len(order):
        most = int(sizes[order[start]])
        own = order[start : start + max(1, TREE_CELLS // max(1, most))]
        start += len(own)
        if most < 2:
            continue
        points, left, rows = np.zeros((len(own), most, windows[own[0]].shape[1])), np.zeros((len(own), most), bool), np.arange(len(own))
        for k, w in enumerate(own):
            points[k, : sizes[w]], left[k, 1 : sizes[w]] = windows[w], True
        gap, edges = np.full(left.shape, np.inf), np.zeros((len(own), most - 1))
        new = points[:, 0]
        for step in range(most - 1):
            gap = np.where(left, np.minimum(gap, np.sqrt(((points - new[:, None]) ** 2).sum(2))), np.inf)
            at = gap.argmin(1)
            edges[:, step] = gap[rows, at]
            left[rows, at] = False
            new = points[rows, at]
        for k, w in enumerate(own):
            out[w] = edges[k, : max(0, sizes[w] - 1)]
    return out


def evenness(points: np.ndarray) -> float | None:
    """How regular the edges of the spanning tree are."""
    return _evenness(spanning_tree(points))


def _evenness(edges: np.ndarray) -> float | None:
    s = len(edges) + 1
    if s < 3 or edges.sum() == 0:
        return None
    share = edges / edges.sum()
    return float((np.minimum(share, 1 / (s - 1)).sum() - 1 / (s - 1)) / (1 - 1 / (s - 1)))


def divergence(points: np.ndarray, vertices: Sequence[int]) -> float | None:
    """How far points lie from the centre of the hull's vertices, against the mean of that."""
    d = np.sqrt(((points - points[list(vertices)].mean(0)) ** 2).sum(1))
    mean = d.mean()
    total = np.abs(d - mean).mean() + mean
    return float(((d - mean).mean() + mean) / total) if total > 0 else None


def dispersion(points: np.ndarray) -> float:
    return float(np.sqrt(((points - points.mean(0)) ** 2).sum(1)).mean())


def rao(points: np.ndarray, block: int = 512) -> float:
    """Mean distance over all ordered pairs, a block of rows at a time."""
    total = 0.0
    for start in range(0, len(points), block):
        total += float(np.sqrt(((points[start : start + block, None, :] - points[None, :, :]) ** 2).sum(2)).sum())
    return total / len(points) ** 2


def metrics_of(points: np.ndarray, metrics: Sequence[str]) -> dict[str, float | None]:
    """The metrics of one window; null where there are no more pixels than traits or a metric is undefined."""
    return metrics_of_windows([points], metrics)[0]


def metrics_of_windows(windows: Sequence[np.ndarray], metrics: Sequence[str]) -> list[dict[str, float | None]]:
    """``metrics_of`` each window. Hulls and spanning trees are made side by side, of some ``LOT_POINTS`` points at a time."""
    out: list[dict[str, float | None]] = [dict.fromkeys(metrics) for _ in windows]
    held, total = [], 0
    for w, points in enumerate(windows):
        if len(points) > points.shape[1]:
            held.append(w)
            total += len(points)
        if held and (w == len(windows) - 1 or total >= LOT_POINTS):
            _measure([windows[k] for k in held], metrics, [out[k] for k in held])
            held, total = [], 0
    return out


def _measure(windows: list[np.ndarray], metrics: Sequence[str], out: list[dict[str, float | None]]) -> None:
    """Fill in the metrics of windows that have more pixels than traits."""
    outer = hulls(windows) if {"fric", "fdiv"} & set(metrics) else [None] * len(windows)
    trees = spanning_trees(windows) if "feve" in metrics else [None] * len(windows)
    for points, own, edges, found in zip(windows, outer, trees, out, strict=True):
        if own is not None and "fric" in metrics:
            found["fric"] = own[1]
        if own is not None and "fdiv" in metrics:
            found["fdiv"] = divergence(points, own[0])
        if "feve" in metrics:
            found["feve"] = _evenness(edges)
        if "fdis" in metrics:
            found["fdis"] = dispersion(points)
        if "raoq" in metrics:
            found["raoq"] = rao(points)


def functional(pixels: DataFrame, keys: Sequence[str], traits: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    """``keys`` and the metrics of each window. A window is at most its width squared pixels, so a task holds it.

    Windows come sorted, many in an Arrow batch, and are cut where the keys change; a window that goes on in the next batch waits for it.
    """
    keys, n = list(keys), len(keys)
    raw = pixels.select(*keys, *(F.col(t).cast("double").alias(f"_t{k}") for k, t in enumerate(traits))).dropna()
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in raw.select(*keys).schema)

    def measured(windows: list[pa.Table]) -> pa.RecordBatch:
        found = metrics_of_windows([np.stack([w.column(n + k).to_numpy() for k in range(len(traits))], 1) for w in windows], metrics)
        own = [pa.concat_arrays([w.column(k).chunk(0).slice(0, 1) for w in windows]) for k in range(n)]
        return pa.RecordBatch.from_arrays([*own, *(pa.array([f[m] for f in found], pa.float64()) for m in metrics)], [*keys, *metrics])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([*open_, batch]).combine_chunks()
            changed = np.zeros(whole.num_rows - 1, bool)
            for k in range(n):
                values = whole.column(k)
                changed |= pc.not_equal(values.slice(1), values.slice(0, len(values) - 1)).to_numpy()
            starts = [0, *(np.flatnonzero(changed) + 1).tolist()]
            done = [whole.slice(a, b - a) for a, b in zip(starts, starts[1:], strict=False)]
            open_ = whole.slice(starts[-1]).to_batches()
            if done:
                yield measured(done)
        if open_:
            yield measured([pa.Table.from_batches(open_).combine_chunks()])

    sorted_rows = raw.repartition(*keys).sortWithinPartitions(*keys)
    return sorted_rows.mapInArrow(run, fields + "".join(f", {m} double" for m in metrics))


def functional_1d(pixels: DataFrame, keys: Sequence[str], trait: str) -> DataFrame:
    """``fric`` (range), ``fdis`` and ``raoq`` of one trait with built-in functions only.

    Sorted, the sum of all pairwise differences is linear in the ranks, so no pairs are made.
    """
    window = Window.partitionBy(*keys)
    x = F.col(trait).cast("double")
    ranked = pixels.select(*keys, x.alias("x")).dropna().select(*keys, "x", F.avg("x").over(window).alias("m"), F.count("x").over(window).alias("n"), F.row_number().over(window.orderBy("x")).alias("i"))
    n = F.col("n")
    return ranked.groupBy(*keys).agg((F.max("x") - F.min("x")).alias("fric"), F.avg(F.abs(F.col("x") - F.col("m"))).alias("fdis"), (F.sum((2 * F.col("i") - n - 1) * F.col("x")) * 2 / F.max(n.cast("double") * n)).alias("raoq"))
