"""Connected components as joins: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sealtrail.sources.scratch import stored


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v, m): both directions of each edge, with the least of ``u`` and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    linked = _with_least(edges).where("v > u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges run from the larger node ``u`` to smaller ones; all of these go to their least."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge.

    Ends with a star per component, after a number of rounds that grows with the logarithm of
    the longest path.  Every round is written to the shared folder, so lost executors only
    repeat one.  Loops, repeated edges and nulls on either side are ignored.
    """
    up = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    some = F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    now, before = stored(edges.where(some).select(*up).distinct(), "edges"), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        now = stored(_small_star(_large_star(now)), "edges")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
