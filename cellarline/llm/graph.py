"""Connected components of an undirected graph, by contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellarline.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``id``, ``component`` (the smallest id reachable) for all nodes of ``edges`` (columns ``a``, ``b`` of longs).

    In each round every node joins its neighbour, or itself, with the lowest hash under that round's seed, and the
    nodes that were joined to become the next, smaller graph: a star is gone in one round, a path loses a constant
    share of its nodes. Each round is two equi-joins, whose hot keys Spark splits, and one aggregate that combines
    before its shuffle; tables are written between rounds. Loops, repeated edges and null ends do no harm.
    """
    a, b = F.least("a", "b"), F.greatest("a", "b")
    edges = stored(edges.dropna().select(a.alias("a"), b.alias("b")).where("a <> b").distinct(), "edges")
    members = None
    for seed in range(200):
        if edges.isEmpty():
            break
        both = edges.union(edges.select("b", "a"))
        order = lambda c: F.struct(F.xxhash64(F.lit(seed), c).alias("h"), c.alias("id"))  # noqa: B023, E731
        lowest = both.groupBy("a").agg(F.min(order(F.col("b"))).alias("m"))
        joined = F.least(F.col("m"), order(F.col("a")))["id"]
        target = stored(lowest.select(F.col("a").alias("node"), joined.alias("to")), "targets")
        if members is None:
            members = target.select(F.col("node").alias("id"), F.col("to").alias("rep"))
        else:
            moved = members.join(target, members["rep"] == target["node"], "left")
            members = stored(moved.select("id", F.coalesce("to", "rep").alias("rep")), "members")
        left = edges.join(target, edges["a"] == target["node"]).select(F.col("to").alias("a"), "b")
        right = left.join(target, left["b"] == target["node"]).select("a", F.col("to").alias("b"))
        low, high = F.least("a", "b"), F.greatest("a", "b")
        edges = stored(right.where("a <> b").select(low.alias("a"), high.alias("b")).distinct(), "edges")
    else:
        raise RuntimeError("the graph did not contract")
    if members is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    smallest = stored(members.groupBy("rep").agg(F.min("id").alias("component")), "smallest")
    return members.join(smallest, "rep").select("id", "component")


def forest(near, count: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest over places 0..count-1; ``near(k, places)`` says which of ``places`` link with k.

    Places that are reached leave the comparison, so a tight group costs little more than its size.
    """
    left, edges = np.arange(count), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            k = queue.pop()
            hit = near(k, left)
            found = left[hit]
            edges += [(k, int(x)) for x in found]
            queue += found.tolist()
            left = left[~hit]
    return edges
