"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.session import cut_lineage

# A hub holds at least this share of all edge ends, so there are at most 2 / share of them.
HUB_SHARE = 1e-3


def _minimum(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Smallest neighbour (or self) and degree per node, combined map-side."""
    ends = edges.select(F.col("hi").alias("node"), F.col("lo").alias("other"))
    if both_ways:
        ends = ends.unionByName(edges.select(F.col("lo").alias("node"), F.col("hi").alias("other")))
    found = ends.groupBy("node").agg(F.min("other").alias("m"), F.count(F.lit(1)).alias("degree"))
    return found.withColumn("m", F.least("node", "m"))


def _attach_minimum(edges: DataFrame, minimum: DataFrame, key: str, total: int) -> DataFrame:
    """Join every edge to the minimum of its ``key`` node; hub nodes never meet in one task.

    The few hubs (bounded by ``HUB_SHARE``) go by broadcast, so the edges of a hub stay where
    they are; all other nodes go by a shuffle join.
    """
    named = lambda m: m.select(F.col("node").alias(key), "m")
    is_hub = F.col("degree") >= total * HUB_SHARE
    hubs, others = named(minimum.where(is_hub)), named(minimum.where(~is_hub))
    via_hub = edges.join(F.broadcast(hubs), key)
    rest = edges.join(F.broadcast(hubs.select(key)), key, "left_anti").join(others, key)
    return via_hub.unionByName(rest)


def _size_and_tangles(edges: DataFrame) -> tuple[int, int]:
    """The number of edges and of nodes that keep a component from being a star.

    In a star every node either has exactly one smaller neighbour and no larger one, or only larger ones.
    """
    ends = edges.select(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("lo").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    row = nodes.agg(
        F.coalesce(F.sum("up"), F.lit(0)).alias("size"),
        F.count_if((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") == 1))).alias("tangles"),
    ).first()
    return row["size"], row["tangles"]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """``(node, component)`` for every node with an edge; the component is its smallest node.

    Each round rewires edges towards the smallest known node, until every component is a star.
    The edges are a written table after each round, so a lost executor costs one round at most.
    """
    pairs = edges.select(F.greatest(src, dst).alias("hi"), F.least(src, dst).alias("lo"))
    alone = pairs.where("hi = lo").select(F.col("hi").alias("node")).distinct()
    current = cut_lineage(pairs.where("hi > lo").distinct())
    for _ in range(max_rounds):
        size, tangles = _size_and_tangles(current)
        if not tangles:
            break
        # Large star: larger neighbours of a node move to its minimum.
        large = _attach_minimum(current, _minimum(current, both_ways=True), "lo", size)
        large = large.select("hi", F.col("m").alias("lo")).where("hi > lo").distinct()
        # Small star: the node and its smaller neighbours move to its minimum.
        small = _attach_minimum(large, _minimum(large, both_ways=False), "hi", size)
        moved = small.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(
            small.select("hi", F.col("m").alias("lo"))
        )
        current = cut_lineage(moved.where("hi > lo").distinct())
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    stars = current.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = current.select(F.col("lo").alias("node"), F.col("lo").alias("component"))
    loners = alone.select("node", F.col("node").alias("component"))
    return stars.unionByName(roots).unionByName(loners).groupBy("node").agg(F.min("component").alias("component"))
