"""Connected components by label propagation with pointer jumping, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node that has a link.

    ``edges`` has the columns a and b of one ordered type (null ends are left out); the result has node and
    component, one row per node. Each round contracts the links: every node points to its smallest neighbour, two
    pointer jumps follow, and links go on between the nodes pointed to. A round at least halves the nodes that still have
    links, so rounds grow with the logarithm of the nodes; links lie in the shared scratch folder between rounds.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    live = materialise(edges.where("a is not null and b is not null").select("a", "b"), "links")
    levels = []
    while True:
        nearest = both(live).groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("up"))
        up = materialise(nearest, "pointers")
        if up.isEmpty():
            break
        for _ in range(2):
            higher = up.select(F.col("a").alias("up"), F.col("up").alias("top"))
            up = up.join(higher, "up").select("a", F.col("top").alias("up"))
        up = materialise(up, "pointers")
        levels.append(up)
        # a link goes on between the nodes that its ends point to
        left = live.join(up, "a").select("b", F.col("up").alias("to"))
        right = left.join(up.withColumnRenamed("a", "b"), "b").select(F.col("to").alias("a"), F.col("up").alias("b"))
        live = materialise(right.where("a <> b").distinct(), "links")
    if not levels:
        return live.select(F.col("a").alias("node"), F.col("a").alias("component"))
    found = levels[-1]
    for lower in reversed(levels[:-1]):
        top = found.select(F.col("a").alias("up"), F.col("up").alias("top"))
        found = lower.join(top, "up", "left").select("a", F.coalesce("top", "up").alias("up"))
    return found.select(F.col("a").alias("node"), F.col("up").alias("component"))
