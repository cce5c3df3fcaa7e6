"""Ball k-means over integer vectors, exact.

A cluster is a ball: its centroid and a radius that holds its members (Xia et al. 2020). In each round, of a ball with
centroid ``c`` and a member ``x``:

* another centroid ``c'`` is a neighbour if ``|c - c'| / 2`` is within the radius; others can't take a member;
* the member is in the stable core if it is nearer than half the way to the nearest neighbour: it stays, and
  nothing else is computed for it;
* else it is in an annulus: between half the ways to the k-th and the next neighbour it is compared with the k nearest
  neighbours only, exactly.

All tests are on squared integers (``|c - c'|² <= 4 |x - c|²``, ties compared), so the result is that of Lloyd's algorithm, to the last
bit, ties to the smaller number. A ball's radius needs no pass of its own: after its centroid moves by ``s`` its members are within the
old radius plus ``s``.

A round is one pass: tasks read vectors with their cluster, assign them anew, and add up counts, sums and radii
by cluster, which Spark sums (decimals, so that no sum overflows). A round's table is written to the
shared folder and the one before it deleted. Only centroids and radii (``k`` rows) come to the driver and are broadcast.

Cases: a vector that is null, of another length or has a component null, NaN or infinite is left out; a component
beyond ``MAX_COMPONENT`` integer units raises, as its distances don't fit a long; fewer vectors than ``k`` give as many centroids as vectors;
repeated rows count each, and repeated identifiers start in the order of their vectors; a null identifier is hashed as
empty text; equal distances go to the smaller number; an empty cluster keeps its centroid; an empty table gives
an empty table. Only the columns named are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import materialize, no_clash, remove, slices

CLUSTERS, ROUNDS, DIMENSIONS, UNITS, SEED = 40, 5, 64, 256, 2
#: Largest component, so that a squared distance over 64 components is below 2^62.
MAX_COMPONENT = 1 << 27
#: Components up to this have squared distances that doubles add exactly.
EXACT_IN_DOUBLE = 1 << 22
ROWS = 4096


def usable(vectors: DataFrame, vector_col: str, dimensions: int, units: int, *more: str) -> DataFrame:
    """``vector`` (array of long: floor of ``units`` times each component) of the rows that have a whole one."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    wide = vectors.select(*more, F.col(vector_col).cast("array<double>").alias("_wide"))
    whole = wide.filter((F.size("_wide") == dimensions) & F.forall("_wide", finite))
    inside = F.forall("_wide", lambda x: F.abs(x * units) <= MAX_COMPONENT)
    checked = F.when(inside, F.transform("_wide", lambda x: F.floor(x * units))).otherwise(F.raise_error(F.lit(f"a component is beyond {MAX_COMPONENT // units}")))
    return whole.select(*more, checked.alias("vector"))


def first_centroids(rows: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors whose identifiers have the smallest hashes."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("name").cast("string"), F.lit(""))), 256)
    first = rows.select(order.alias("order"), "vector").orderBy("order", "vector").limit(clusters).collect()
    return np.array([r.vector for r in first], np.int64)


def packed(grid: np.ndarray) -> pa.Array:
    """Rows as binary values of the narrowest integers that hold them."""
    top = int(np.abs(grid).max(initial=0))
    narrow = np.ascontiguousarray(grid.astype(np.int16 if top < 1 << 15 else np.int32))
    return pa.array([row.tobytes() for row in narrow], pa.binary())


def unpacked(column: pa.Array, dimensions: int) -> np.ndarray:
    values = column.to_pylist()
    out = np.empty((len(values), dimensions), np.int64)
    sizes = np.array([len(v) for v in values])
    for width, kind in ((2, np.int16), (4, np.int32)):
        mine = np.flatnonzero(sizes == width * dimensions)
        out[mine] = np.frombuffer(b"".join(values[i] for i in mine), kind).reshape(len(mine), dimensions)
    return out


def squared(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Squared distances of rows to a point, as exact integers."""
    if max(int(np.abs(rows).max(initial=0)), int(np.abs(point).max(initial=0))) <= EXACT_IN_DOUBLE:
        apart = rows.astype(np.float64) - point
        return np.einsum("ij,ij->i", apart, apart).astype(np.int64)
    apart = rows - point
    return np.einsum("ij,ij->i", apart, apart)


class Balls:
    """Centroids, the squared distances between them, and each ball's neighbours in order of distance."""

    def __init__(self, centroids: np.ndarray, radius: Sequence[float]):
        k = len(centroids)
        self.centroids = centroids
        between = np.array([squared(centroids, c) for c in centroids]).reshape(k, k)
        self.neighbours, self.ways = [], []
        for i in range(k):
            # Twice the radius squared, rounded up.
            reach = (2 * radius[i]) ** 2 * (1 + 1e-9) + 1
            near = [j for j in np.argsort(between[i], kind="stable") if j != i and between[i, j] <= reach]
            self.neighbours.append(near)
            self.ways.append(between[i, near])

    def assign(self, rows: np.ndarray, cluster: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid and squared distance of rows, given the ball that each is in."""
        best, distance = cluster.copy(), np.zeros(len(rows), np.int64)
        for i in np.unique(cluster):
            mine = np.flatnonzero(cluster == i)
            own = rows[mine]
            d = squared(own, self.centroids[i])
            # The annulus: how many neighbours are near enough to be compared; none in the stable core.
            annulus = np.searchsorted(self.ways[i], 4 * d, "right")
            order = np.argsort(-annulus, kind="stable")
            nearest, least = np.full(len(mine), i), d.copy()
            depth = annulus[order]
            for k, j in enumerate(self.neighbours[i]):
                compared = order[: int(np.searchsorted(-depth, -k, "left"))]
                if not len(compared):
                    break
                other = squared(own[compared], self.centroids[j])
                better = (other < least[compared]) | ((other == least[compared]) & (j < nearest[compared]))
                nearest[compared[better]], least[compared[better]] = j, other[better]
            best[mine], distance[mine] = nearest, least
        return best, distance


def _round(rows: DataFrame, balls: Balls, dimensions: int, first: bool) -> DataFrame:
    """The rows with their new cluster and distance, and one more row for each task and cluster: its ``sums``."""
    shared = rows.sparkSession.sparkContext.broadcast(balls)
    k = len(balls.centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, inertia, radius = np.zeros(k, np.int64), [0] * k, np.zeros(k, np.int64)
        sums = np.zeros((k, dimensions), np.int64)
        name_type = None
        for batch in slices(batches, ROWS):
            name_type = batch.column(0).type
            if first:
                grid = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, dimensions)
                before = np.zeros(batch.num_rows, np.int64)
                vector = packed(grid)
            else:
                vector = batch.column(1)
                grid = unpacked(vector, dimensions)
                before = batch.column(2).to_numpy().astype(np.int64)
            cluster, distance = shared.value.assign(grid, before)
            for i in np.unique(cluster):
                mine = cluster == i
                count[i] += mine.sum()
                inertia[i] += int(distance[mine].sum())
                radius[i] = max(radius[i], distance[mine].max())
                sums[i] += grid[mine].sum(0)
            none = pa.nulls(batch.num_rows, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), vector, pa.array(cluster, pa.int32()), pa.array(distance), none], names)
        some = np.flatnonzero(count)
        if not len(some):
            return
        totals = pa.array([[int(count[i]), inertia[i], int(radius[i]), *sums[i].tolist()] for i in some], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.nulls(len(some), name_type), pa.nulls(len(some), pa.binary()), pa.array(some, pa.int32()), pa.nulls(len(some), pa.int64()), totals], names)

    names = ["name", "vector", "cluster", "distance", "sums"]
    return rows.mapInArrow(run, f"name {rows.schema['name'].dataType.simpleString()}, vector binary, cluster int, distance bigint, sums array<bigint>")


def totals(table: DataFrame) -> dict[int, list[int]]:
    """Count, inertia, largest squared distance and sums of components by cluster."""
    parts = table.filter(F.col("sums").isNotNull()).select("cluster", F.posexplode("sums").alias("at", "part"))
    added = parts.groupBy("cluster", "at").agg(F.sum(F.col("part").cast("decimal(20,0)")).alias("total"), F.max("part").alias("most")).collect()
    out: dict[int, list[int]] = {}
    for r in sorted(added, key=lambda r: (r.cluster, r.at)):
        out.setdefault(r.cluster, []).append(int(r.most if r.at == 2 else r.total))
    return out


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, units: int = UNITS, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The identifier, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia`` and ``centroid`` (array of long) of every vector."""
    no_clash([id_col], "name", "vector", "cluster", "distance", "sums", "cluster_inertia", "inertia", "centroid")
    spark = vectors.sparkSession
    rows = usable(vectors.withColumn("name", F.col(id_col)), vector_col, dimensions, units, "name")
    centroids = first_centroids(rows, clusters, seed)
    found = rows.select(F.col("name").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"))
    if not len(centroids):
        return found.select("*", *(F.lit(0).cast("bigint").alias(c) for c in ("cluster_inertia", "inertia")), F.lit(None).cast("array<bigint>").alias("centroid"))
    radius: list[float] = [math.inf] * len(centroids)
    table, state = None, rows
    for step in range(rounds + 1):
        after = materialize(_round(state, Balls(centroids, radius), dimensions, step == 0), "balls")
        if table is not None:
            remove(spark, table)
        table, total = after, totals(after)
        state = table.filter("sums is null").select("name", "vector", "cluster")
        if step == rounds:
            break
        moved = np.array([[s // total[i][0] for s in total[i][3:]] if i in total else centroids[i] for i in range(len(centroids))], np.int64)
        radius = [math.sqrt(total[i][2]) + math.sqrt(int(squared(moved[i : i + 1], centroids[i])[0])) if i in total else 0.0 for i in range(len(centroids))]
        centroids = moved
    # One row for each cluster.
    known = spark.createDataFrame([(i, t[1], centroids[i].tolist()) for i, t in total.items()], "cluster int, cluster_inertia bigint, centroid array<bigint>")
    inertia = sum(t[1] for t in total.values())
    found = table.filter("sums is null").select(F.col("name").alias(id_col), "cluster", "distance")
    return found.join(F.broadcast(known), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", F.lit(inertia).cast("bigint").alias("inertia"), "centroid")
