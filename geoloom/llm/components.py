"""Connected components of an edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from geoloom.llm.common import materialize, release


#: Edges a file and task of the rounds: few edges should not cost a task a shuffle partition.
EDGES_A_PART = 50_000


def _least_neighbour(pairs: DataFrame, parts: int) -> DataFrame:
    """(u, m): the smallest of u and its neighbours; partially aggregated, and written so that the join to it can split hot u."""
    return materialize(pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")), "cc-least", parts)


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(a, b) long pairs -> (node, root) for every node that is no root; root is the smallest node reachable.

    Every round writes its edges to the shared folder and drops the last
    round's, so that lost executors cost one round at most.
    """
    star = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-edges")
    parts = 2 * star.count() // EDGES_A_PART + 1
    for _ in range(most_rounds):
        # large star: u hands its larger neighbours over to the smallest one
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least_neighbour(both, parts)
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "cc-large", parts)
        # small star: u and its smaller neighbours go to the smallest of them
        least2 = _least_neighbour(large, parts)
        moved = large.join(least2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = materialize(moved.unionByName(least2.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "cc-edges", parts)
        for old in (star, least, large, least2):
            release(old)
        star = small
        # done when every node has one parent and no parent has one
        shape = star.agg(F.count("*").alias("n")).first()["n"], star.select("u").distinct().count()
        if shape[0] == shape[1] and star.join(star.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return star.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
