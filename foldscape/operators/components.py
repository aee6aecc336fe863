"""Connected components of graphs of any size, by alternating star contraction.

Each round joins every node to the least of its neighbours and itself, first for
neighbours above it (large star), then for those below (small star), until the edges
form stars around the least node of each component: O(log n) rounds as a rule.  Rounds
are written to the shared folder, which cuts lineage and outlives executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import dropped, join_batch, kept, ranked


def star_contraction(edges: DataFrame, batch: Sequence[str] = (), src: str = "src", dst: str = "dst") -> DataFrame:
    """batch..., node, component: the least node of its component, for every node that has an edge to another.

    batch names columns that keep graphs apart. Loops and repeated edges are allowed; null ends are dropped.
    """
    b = [F.col(c) for c in batch]
    keys = [*batch, "u"]
    e = edges.where(F.col(src) != F.col(dst)).select(*b, F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct()
    e = kept(e, "edges")
    before = None
    while True:
        both = e.unionByName(e.select(*b, F.col("v").alias("u"), F.col("u").alias("v")))
        # a row for each node, dealt anew, so that the join's sides are shuffled for it alone and a hub's many edges can be split
        least = both.groupBy(*keys).agg(F.least(F.min("v"), F.col("u")).alias("m")).hint("rebalance")
        # large star: v above u goes to the least of u's neighbourhood
        large = both.where("v > u").join(least, keys).select(*b, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its lower neighbours go to the least of them
        low = large.groupBy(*keys).agg(F.min("v").alias("m")).hint("rebalance")
        small = large.join(low, keys).where("v != m").select(*b, F.col("v").alias("u"), F.col("m").alias("v")).union(low.select(*b, "u", F.col("m").alias("v"))).distinct()
        old, e = e, kept(small, "edges")
        dropped(old)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*keys, "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(*b, F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(*b, F.col("v"), F.col("v")).distinct())
        before = now


def connected_components(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = ("seq_id", "run_id", "null_id")) -> DataFrame:
    """keys, node_id, component (its least node), comp_size; an isolated node is its own component."""
    found = star_contraction(edges, keys).withColumnRenamed("node", "node_id")
    each = nodes.select(*keys, "node_id").join(found, [*keys, "node_id"], "left").withColumn("component", F.coalesce("component", "node_id"))
    sizes = each.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("comp_size"))
    return each.join(sizes, [*keys, "component"]).select(*keys, "node_id", "component", "comp_size")


def component_order(members: DataFrame, keys: Sequence[str] = ("seq_id", "run_id", "null_id")) -> DataFrame:
    """keys, component, comp_size, comp_id: components from the largest down, ties by the least node."""
    each = members.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("comp_size"))
    ordered = ranked(each.withColumn("_size", -F.col("comp_size")), "comp_id", ["_size", "component"], keys)
    return ordered.select(*keys, "component", "comp_size", F.col("comp_id").cast("int").alias("comp_id"))


def significant_components(members: DataFrame, alpha: float, keys: Sequence[str] = ("seq_id", "run_id", "null_id")) -> DataFrame:
    """keys, component, comp_size, comp_id of components with at least max(3, int(alpha * N)) of the batch's N nodes."""
    total = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return join_batch(component_order(members, keys), total, list(keys)).where(F.col("comp_size") >= F.greatest(F.lit(3), F.floor(F.col("_n") * alpha))).drop("_n")


def main_component(members: DataFrame, alpha: float, keys: Sequence[str] = ("seq_id", "run_id", "null_id")) -> DataFrame:
    """The first significant component of each batch."""
    return significant_components(members, alpha, keys).where("comp_id = 0")
