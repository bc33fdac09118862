"""Connected components of an edge list by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.shared import drop, stored


def _summary(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, src: str, dst: str, max_rounds: int = 100, settle: bool = True) -> DataFrame:
    """(node, root): root is the least node of the component; nodes without an edge to another are left out.

    Without ``settle`` it ends after ``max_rounds``: then root is some node of the component, and nodes that have no lesser neighbour are left out too.

    ``edges`` has two bigint columns; null ends and loops are ignored, repeats do no harm. Each round is written
    to the shared folder. Minima are pre-aggregated before their shuffle, and the joins read stored
    tables on both sides, so that adaptive execution can split a node that a third of all edges share.
    """
    now = stored(
        edges.select(F.greatest(src, dst).alias("hi"), F.least(src, dst).alias("lo")).filter("hi > lo").distinct(), "edges"
    )
    was = _summary(now)
    for _ in range(max_rounds):
        if not was[0]:
            break
        both = now.unionByName(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))  # (node, neighbour)
        least = stored(both.groupBy("hi").agg(F.least("hi", F.min("lo")).alias("root")), "least")
        large = both.filter("lo > hi").join(least, "hi").select(F.col("lo").alias("hi"), F.col("root").alias("lo"))
        # a node's own least neighbour stays linked to it, so that a local minimum keeps its edges
        down = stored(large.filter("hi > lo").distinct(), "large")
        low = stored(down.groupBy("hi").agg(F.min("lo").alias("root")), "low")
        star = down.join(low, "hi").filter("lo > root").select(F.col("lo").alias("hi"), F.col("root").alias("lo"))
        before, now = now, stored(star.unionByName(low.withColumnRenamed("root", "lo")).distinct(), "edges")
        drop(before, least, down, low)
        if settle:
            if (is_now := _summary(now)) == was:
                break
            was = is_now
    else:
        if not settle:
            return now.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root"))
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
