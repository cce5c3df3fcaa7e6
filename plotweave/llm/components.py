"""Connected components of a graph in a DataFrame, by alternating stars.

Large-star links every larger neighbour of a node to the smallest node around it,
small-star every smaller one; after a few rounds each component is a star around its
smallest node (Kiveris et al. 2014). Each round is written to the shared folder, and
the one before it deleted. Nothing but counts comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import materialize, remove


def _star(edges: DataFrame) -> DataFrame:
    """Links (``u``, ``v``) as (``v``, smallest of ``u`` and its ``v``)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
    return edges.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"), F.col("u").alias("c"))


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _star(both).filter(F.col("a") > F.col("c")).select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    star = _star(down)
    linked = star.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(star.select(F.col("c").alias("u"), F.col("b").alias("v")))
    return linked.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node reachable, for nodes that have an edge and aren't a root.

    ``edges`` has ``u`` and ``v`` of one orderable type; loops and repeats do no harm.
    """
    state = materialize(edges.filter("u <> v").select("u", "v").distinct(), "edges")
    mark = None
    while True:
        after = materialize(small_star(large_star(state)), "edges")
        now = tuple(after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        remove(state.sparkSession, state)
        state = after
        if now == mark:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
