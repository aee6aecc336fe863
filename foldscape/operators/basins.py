"""Gradient basins of an energy landscape, and their weights.

A node points to its neighbour of least (energy, node_id) if that is lower by more than a
tolerance; a node without such a neighbour is a candidate.  Candidates joined by edges of
equal energy are one attractor, named by its least node; a node belongs to the attractor
that its pointers lead to.  A candidate with a flat edge to a node that has a pointer is
still its own attractor.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import dropped, kept
from .components import star_contraction
from .neighbors import both_ways
from .structures import KEYS

TOLERANCE = 1e-9


def descent_pointers(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS, tolerance: float = TOLERANCE) -> DataFrame:
    """keys, node_id, energy, pointer (null for candidates, isolated nodes among them)."""
    ends = nodes.select(*keys, F.col("node_id").alias("dst"), F.col("energy").alias("e_dst"))
    best = both_ways(edges, keys).join(ends, [*keys, "dst"]).groupBy(*keys, F.col("src").alias("node_id")).agg(F.min(F.struct("e_dst", "dst")).alias("best"))
    lower = F.when(F.col("best.e_dst") < F.col("energy") - tolerance, F.col("best.dst"))
    return nodes.select(*keys, "node_id", "energy").join(best, [*keys, "node_id"], "left").select(*keys, "node_id", "energy", lower.alias("pointer"))


def descent_candidates(pointers: DataFrame) -> DataFrame:
    """Nodes without a pointer."""
    return pointers.where("pointer is null").drop("pointer")


def plateau_attractors(pointers: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS, tolerance: float = TOLERANCE) -> DataFrame:
    """keys, node_id, attractor of every candidate: the least candidate that it reaches over flat edges between candidates."""
    c = descent_candidates(pointers)
    a = c.select(*keys, F.col("node_id").alias("src"), F.col("energy").alias("e_src"))
    b = c.select(*keys, F.col("node_id").alias("dst"), F.col("energy").alias("e_dst"))
    flat = edges.select(*keys, "src", "dst").join(a, [*keys, "src"]).join(b, [*keys, "dst"]).where(F.abs(F.col("e_src") - F.col("e_dst")) < tolerance)
    found = star_contraction(flat, keys).withColumnRenamed("node", "node_id")
    return c.join(found, [*keys, "node_id"], "left").select(*keys, "node_id", F.coalesce("component", "node_id").alias("attractor"))


def basin_assignment(pointers: DataFrame, attractors: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, node_id, basin_id of every node, by pointer jumping: each round halves the way to the attractor."""
    on = [*keys, "node_id"]
    table = step = kept(pointers.join(attractors, on, "left").select(*keys, "node_id", F.coalesce("pointer", "node_id").alias("to")), "pointers")
    while True:
        over = step.select(*keys, F.col("node_id").alias("to"), F.col("to").alias("next"))
        new = kept(step.join(over, [*keys, "to"]).select(*keys, "node_id", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), "pointers")
        dropped(table)
        table, step = new, new.drop("moved")
        if new.where("moved").isEmpty():
            break
    return step.join(attractors.withColumnRenamed("node_id", "to"), [*keys, "to"]).select(*keys, "node_id", F.col("attractor").alias("basin_id"))


def gradient_basins(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS, tolerance: float = TOLERANCE) -> DataFrame:
    """Pointers, attractors and assignment in one."""
    pointers = kept(descent_pointers(nodes, edges, keys, tolerance), "descent")
    return basin_assignment(pointers, plateau_attractors(pointers, edges, keys, tolerance), keys)


def basin_weights(members: DataFrame, rt: float, keys: Sequence[str] = KEYS, group: str = "comp_id") -> DataFrame:
    """keys, group, basin_id, rep (its least node), size, energy of rep, z = sum of exp(-(E - least E of the group) / RT).

    members: keys, node_id, energy, group, basin_id.
    """
    least = members.groupBy(*keys, group).agg(F.min("energy").alias("_e0"))
    w = members.join(least, [*keys, group]).withColumn("_w", F.exp(-(F.col("energy") - F.col("_e0")) / rt))
    return w.groupBy(*keys, group, "basin_id").agg(F.min("node_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.min_by("energy", "node_id").alias("rep_energy"), F.sum("_w").alias("z"))


def top_basins(basins: DataFrame, min_size: int, most: int, keys: Sequence[str] = KEYS, group: str = "comp_id", least: int = 1) -> DataFrame:
    """Basins of at least min_size nodes, the `most` of largest z in each group, with their rank from 1; groups of fewer than `least` are dropped."""
    w = Window.partitionBy(*keys, group)
    ranked = basins.where(F.col("size") >= min_size).withColumn("rank", F.row_number().over(w.orderBy(F.desc("z"), "basin_id"))).where(F.col("rank") <= most)
    return ranked if least < 2 else ranked.withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") >= least).drop("_n")
