"""Randomised null models as columns: every sample is a batch with its own null_id.

Permutations are orders by a hash of (seed + null_id, node), so a sample is the same on any
cluster and however often a task runs again.  Edges are swapped in rounds, many pairs at once,
so that a sample's edges are spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import shuffled_letters
from ..storage import dropped, join_batch, kept, ranked

#: Added to the run's seed for each model, before null_id.
RANDOM_BASINS, ENERGY, TOPOLOGY, LETTERS = 20_000, 30_000, 40_000, 50_000
#: Edges that are paired among one another, about; rounds of swaps between two tables; tables in which nothing was swapped before the end.
BUNCH, AT_ONCE, STILL = 16, 4, 10


def with_samples(df: DataFrame, n: int) -> DataFrame:
    """Each row n times, with null_id from 0; replaces a null_id that is there."""
    return df.withColumn("null_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def shuffled_energies(nodes: DataFrame, n: int, seed: int, keys: Sequence[str] = ("seq_id", "run_id")) -> DataFrame:
    """keys, node_id, energies: of each sample the energy dealt to the node, all samples in one array over one topology.

    The node of rank r by node_id gets the energy of the node of rank r by the sample's hash; ranks come from counted ranges.
    """
    own = ranked(nodes.select(*keys, "node_id"), "_place", ["node_id"], keys)
    every = with_samples(nodes.select(*keys, "node_id", "energy"), n).withColumn("_hash", F.xxhash64(F.lit(seed + ENERGY) + F.col("null_id"), "node_id"))
    dealt = ranked(every, "_place", ["_hash", "node_id"], [*keys, "null_id"])
    lists = dealt.groupBy(*keys, "_place").agg(F.array_sort(F.collect_list(F.struct("null_id", "energy"))).alias("_all"))
    return own.join(lists, [*keys, "_place"]).select(*keys, "node_id", F.transform("_all", lambda x: x["energy"]).alias("energies"))


def energy_shuffle(nodes: DataFrame, n: int, seed: int, keys: Sequence[str] = ("seq_id", "run_id")) -> DataFrame:
    """The nodes of each batch in n samples, with the batch's energies dealt anew over all of its nodes."""
    energies = shuffled_energies(nodes, n, seed, keys).select(*keys, "node_id", F.posexplode("energies").alias("_k", "_energy"))
    others = nodes.drop("energy", "null_id").join(energies, [*keys, "node_id"])
    return others.withColumnsRenamed({"_k": "null_id", "_energy": "energy"})


def _proposals(edges: DataFrame, on: Sequence[str], seed: int, turn: int) -> DataFrame:
    """Edges in pairs, by hash: on, id, olds (one edge or two), news (what the pair may become; empty if it can't be swapped).

    Each edge falls into one of _buckets groups of some BUNCH edges, where those next to one another by hash are pairs; which of
    the two swaps a pair may make is a coin of the hash too.
    """
    h = F.xxhash64(F.lit(seed), F.lit(turn), *on, "src", "dst")
    each = edges.select(*on, "_buckets", F.struct(h.alias("h"), "src", "dst", "swaps").alias("e")).withColumn("bucket", F.pmod(F.xxhash64(F.col("e.h"), F.lit(1)), F.col("_buckets")))
    bunch = each.groupBy(*on, "_buckets", "bucket").agg(F.array_sort(F.collect_list("e")).alias("es"))  # some BUNCH edges
    two = F.transform(F.sequence(F.lit(1), F.size("es"), F.lit(2)), lambda i: F.slice(F.col("es"), i, F.lit(2)))
    pairs = bunch.select(*on, "_buckets", "bucket", F.posexplode(two).alias("k", "olds")).withColumn("id", F.struct("bucket", "k"))
    a, b = F.col("olds")[0], F.get("olds", F.lit(1))
    turned = F.pmod(F.xxhash64(a["h"], b["h"]), F.lit(2)) == 1
    c, d = F.when(turned, b["dst"]).otherwise(b["src"]), F.when(turned, b["src"]).otherwise(b["dst"])
    edge = lambda u, v, old: F.struct(F.least(u, v).alias("src"), F.greatest(u, v).alias("dst"), (old["swaps"] + 1).alias("swaps"))
    apart = (a["src"] != c) & (a["src"] != d) & (a["dst"] != c) & (a["dst"] != d)
    news = F.when(b.isNotNull() & apart, F.array(edge(a["src"], d, a), edge(c, a["dst"], b)))
    olds = F.transform("olds", lambda e: F.struct(e["src"], e["dst"], e["swaps"]))
    return pairs.select(*on, "_buckets", "id", olds.alias("olds"), F.coalesce(news, F.array().cast("array<struct<src:bigint,dst:bigint,swaps:bigint>>")).alias("news"))


def _swapped(edges: DataFrame, on: Sequence[str], seed: int, turn: int) -> DataFrame:
    """The edges after one round of swaps, all at once.

    A pair is swapped if none of the four edges that it has or would have is an edge, old or new, of another pair, and its new
    edges aren't there yet.  The same pairs of the graph that comes of it lead back with the same probability, so that all graphs
    with these degrees are equally likely in the long run.
    """
    found = _proposals(edges, on, seed, turn)
    ends = lambda c, new: F.transform(c, lambda e: F.struct(F.lit(new).alias("new"), e["src"].alias("src"), e["dst"].alias("dst"), e["swaps"].alias("swaps")))
    touched = found.select(*on, "_buckets", "id", F.explode(F.concat(ends("olds", False), ends("news", True))).alias("e"))
    often = F.count(F.lit(1)).over(Window.partitionBy(*on, "e.src", "e.dst"))
    judged = touched.withColumn("_often", often).groupBy(*on, "_buckets", "id").agg(F.collect_list("e").alias("es"), ((F.max("_often") == 1) & F.max("e.new")).alias("_swap"))  # four edges
    return judged.select(*on, "_buckets", F.explode(F.filter("es", lambda e: e["new"] == F.col("_swap"))).alias("e")).select(*on, "_buckets", "e.src", "e.dst", "e.swaps")


def topology_shuffle(edges: DataFrame, n: int, swaps_per_edge: int, seed: int, keys: Sequence[str] = ("seq_id", "run_id"), most: int = 100) -> DataFrame:
    """The edges (src < dst, each once) of each batch in n samples after at least swaps_per_edge swaps for each edge, or most times as many
    tries, or STILL tables without any: the same degrees, other neighbours. Rounds are over all samples; AT_ONCE are written at a time."""
    on = [*keys, "null_id"]
    sizes = edges.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BUNCH).alias("_buckets"))
    given = join_batch(edges.select(*keys, F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")), sizes, list(keys))
    now = kept(with_samples(given.withColumn("swaps", F.lit(0).cast("long")), n).select(*on, "_buckets", "src", "dst", "swaps"), "swapped")
    turn, before, still = 0, None, 0
    while turn < 2 * most * swaps_per_edge and still < STILL:
        new = now
        for _ in range(AT_ONCE):
            new, turn = _swapped(new, on, seed + TOPOLOGY, turn), turn + 1
        new = kept(new, "swapped")
        dropped(now)
        now = new
        each = now.groupBy(*on).agg(F.sum("swaps").alias("made"), F.count(F.lit(1)).alias("n")).where(F.col("made") < 2 * swaps_per_edge * F.col("n"))
        left, made = each.agg(F.count_if(F.col("n") > 1), F.sum("made")).first()
        if not left:
            break
        still = still + 1 if made == before else 0
        before = made
    return now.select(*on, "src", "dst")


def letter_shuffle(sequences: DataFrame, n: int, seed: int) -> DataFrame:
    """Each sequence in n samples with its letters in another order."""
    return with_samples(sequences, n).withColumn("seq", shuffled_letters(F.col("seq"), F.lit(seed + LETTERS) + F.col("null_id"), F.col("seq_id")))


def random_basins(members: DataFrame, n: int, seed: int, keys: Sequence[str] = ("seq_id", "run_id"), group: str = "comp_id") -> DataFrame:
    """keys, null_id, group, node_id, basin_id in n samples: nodes dealt at random to basins of the same sizes; nodes without a basin stay so in number.

    members: keys, group, node_id, basin_id (null for none). The node of rank r by the sample's hash gets the r-th slot of the basins in order.
    """
    on = [*keys, "null_id", group]
    slots = ranked(members.select(*keys, group, "node_id", "basin_id").withColumn("_none", F.col("basin_id").isNull()), "_place", ["_none", "basin_id", "node_id"], [*keys, group])
    every = with_samples(members.select(*keys, group, "node_id"), n).withColumn("_hash", F.xxhash64(F.lit(seed + RANDOM_BASINS) + F.col("null_id"), "node_id"))
    dealt = ranked(every, "_place", ["_hash", "node_id"], on)
    return dealt.join(slots.select(*keys, group, "_place", "basin_id"), [*keys, group, "_place"]).select(*on, "node_id", "basin_id")


def usable_samples(runs: DataFrame) -> DataFrame:
    """Samples with at least one triplet; the others failed."""
    return runs.where(F.coalesce("total_triplets", F.lit(0)) > 0)
