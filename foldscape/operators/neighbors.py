"""The single-move neighbourhood of states that are sets of pairs.

Two states are neighbours if one has a pair that the other lacks, or each has one that the
other lacks.  With valid states that is an equi-join: for each state and each of its pairs,
the key of what is left when the pair is removed meets either a whole state's key (remove
and add) or another such key (shift).  Keys are 64-bit; the sets themselves are compared too.

nodes: keys, node_id, pair_ids (sorted, distinct), pair_hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import ranked
from .structures import KEYS


def without_one(nodes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, node_id, pair, rest and rest_hash for each pair of each state."""
    one = nodes.select(*keys, "node_id", "pair_ids", "pair_hash", F.explode("pair_ids").alias("pair"))
    return one.select(*keys, "node_id", "pair", F.array_remove("pair_ids", F.col("pair")).alias("rest"), F.col("pair_hash").bitwiseXOR(F.xxhash64("pair")).alias("rest_hash"))


def remove_moves(nodes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """src to dst by removing one pair."""
    whole = nodes.select(*keys, F.col("node_id").alias("dst"), F.col("pair_ids").alias("rest"), F.col("pair_hash").alias("rest_hash"))
    return without_one(nodes, keys).withColumnRenamed("node_id", "src").join(whole, [*keys, "rest_hash", "rest"]).select(*keys, "src", "dst")


def add_moves(nodes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """src to dst by adding one pair: the same, the other way round."""
    return remove_moves(nodes, keys).select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))


def shift_moves(nodes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """src < dst by removing any pair and adding any other; each two meet under one rest only."""
    rests = without_one(nodes, keys).drop("pair")
    other = rests.withColumnRenamed("node_id", "dst")
    return rests.withColumnRenamed("node_id", "src").join(other, [*keys, "rest_hash", "rest"]).where("src < dst").select(*keys, "src", "dst")


def canonical_edges(edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Each edge once, src < dst, no loops."""
    return edges.where("src != dst").select(*keys, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def neighbor_graph(nodes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """All moves as undirected edges src < dst. The kinds of move are disjoint, so no distinct is needed."""
    removed = remove_moves(nodes, keys).select(*keys, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return removed.unionByName(shift_moves(nodes, keys))


def both_ways(edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Each edge in both directions."""
    return edges.select(*keys, "src", "dst").unionByName(edges.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst")))


def degrees(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, node_id, degree, 0 for isolated nodes."""
    ends = edges.select(*keys, F.explode(F.array("src", "dst")).alias("node_id")).groupBy(*keys, "node_id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select(*keys, "node_id").join(ends, [*keys, "node_id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))


def edges_within(edges: DataFrame, members: DataFrame, keys: Sequence[str] = KEYS, group: str = "comp_id") -> DataFrame:
    """Edges whose ends are both members of the same group, with it. members: keys, node_id, group."""
    a = members.select(*keys, F.col("node_id").alias("src"), group)
    b = members.select(*keys, F.col("node_id").alias("dst"), F.col(group).alias("_other"))
    return edges.join(a, [*keys, "src"]).join(b, [*keys, "dst"]).where(F.col(group) == F.col("_other")).drop("_other")


def local_ids(members: DataFrame, keys: Sequence[str] = KEYS, group: str = "comp_id") -> DataFrame:
    """Adds local_id: the place of a node in its group, from 0, by node_id."""
    return ranked(members, "local_id", ["node_id"], [*keys, group])
