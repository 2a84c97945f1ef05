"""Graphs on indicators: connected components of a thresholded relation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from geoloom.sources.scratch import drop, kept


#: Edges, by count, that one task may put together; beyond them labels travel in rounds.
EDGES_IN_TASK = 500_000


def _gathered(batches):
    """(node, root) of the edges of a task; root is the least node reachable."""
    import pyarrow as pa

    up: dict[str, str] = {}

    def find(x: str) -> str:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = sorted((find(a), find(b)))
            up[b] = a
    found = sorted(up)
    for k in range(0, len(found), 1 << 16):
        some = found[k : k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([find(x) for x in some], pa.string())], names=["n", "root"])


def connected_components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 200, edges_in_task: int = EDGES_IN_TASK) -> DataFrame:
    """(node) and (a, b) string pairs -> (node, component): the least node reachable.

    Edges are written and counted first; so many as one task can hold are put
    together there.  Beyond that each round is one job: labels take the least label of the neighbours, then
    the label that this one had, and are written to the shared folder with the
    number of changes observed on the way.  A round's files go once the next
    are there; the last are left to the folder's own clean-up.
    """
    spark = nodes.sparkSession
    counted = Observation()
    some = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    once, at_edges = kept(some.observe(counted, F.count(F.lit(1)).alias("n")), "edges")
    if counted.get["n"] <= edges_in_task:
        roots = once.coalesce(1).mapInArrow(_gathered, "n string, root string")
        return nodes.select("node").distinct().join(roots, F.col("node") == F.col("n"), "left").select("node", F.coalesce("root", "node").alias("component"))
    both = once.unionByName(once.select(F.col("b").alias("a"), F.col("a").alias("b")))
    beside = both.groupBy("a").agg(F.min("b").alias("m"))
    start = nodes.select("node").distinct().join(beside, F.col("node") == F.col("a"), "left")
    labels, at = kept(start.select("node", F.least("node", F.coalesce("m", "node")).alias("component")), "labels")
    for _ in range(most_rounds):
        around = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("m"))
        near = labels.join(around, labels["node"] == around["a"], "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("m", "component")).alias("near"))
        up = labels.select(F.col("node").alias("n2"), F.col("component").alias("c2"))
        seen = Observation()
        jumped = near.join(up, near["near"] == up["n2"], "left").select("node", "old", F.least("near", F.coalesce("c2", "near")).alias("component"))
        jumped = jumped.observe(seen, F.sum((F.col("component") != F.col("old")).cast("long")).alias("changed")).drop("old")
        before, (labels, at) = at, kept(jumped, "labels")
        drop(spark, before)
        if not seen.get["changed"]:
            drop(spark, at_edges)
            return labels
    raise RuntimeError("labels did not settle")


def discover_cohorts(corr: DataFrame, nodes: DataFrame, threshold: float = 0.6, min_size: int = 5) -> DataFrame:
    """(node, component, size) of components of |r| >= threshold with ``min_size`` members at least."""
    edges = corr.where(F.abs("corr") >= threshold).select(F.col("id_1").alias("a"), F.col("id_2").alias("b"))
    found = connected_components(nodes, edges)
    sizes = found.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") >= min_size)
    return found.join(sizes, "component").select("node", "component", "size")


def component_count(nodes: DataFrame, corr: DataFrame, threshold: float = 0.3) -> DataFrame:
    edges = corr.where(F.abs("corr") >= threshold).select(F.col("id_1").alias("a"), F.col("id_2").alias("b"))
    return connected_components(nodes, edges).agg(F.count_distinct("component").alias("n_components"), F.count("*").alias("n_nodes"))


def modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Newman's Q of a weighted undirected graph: (a, b, w) with a < b, and (node, cluster)."""
    ends = edges.select(F.col("a").alias("node"), "w").unionByName(edges.select(F.col("b").alias("node"), "w"))
    degree = ends.groupBy("node").agg(F.sum("w").alias("k")).join(membership, "node")
    m2 = degree.agg(F.sum("k").alias("m2"))
    inside = edges.join(membership.select(F.col("node").alias("a"), F.col("cluster").alias("ca")), "a").join(membership.select(F.col("node").alias("b"), F.col("cluster").alias("cb")), "b").where("ca = cb").agg((2 * F.sum("w")).alias("inner"))
    squares = degree.groupBy("cluster").agg(F.sum("k").alias("kc")).agg(F.sum(F.col("kc") * F.col("kc")).alias("sq"))
    one = m2.crossJoin(inside).crossJoin(squares)  # one row each
    return one.select(F.expr("try_divide(coalesce(inner, 0), m2) - try_divide(sq, m2 * m2)").alias("modularity"))
