"""Sampled structures: filters, dot-bracket strings as sets of pairs, and states of a landscape.

`keys` names the columns of a batch (a sequence, a run, a null sample); all operators work
on all batches in one plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import set_key
from ..storage import join_batch, ranked

KEYS = ("seq_id", "run_id", "null_id")


def energy_window(structures: DataFrame, window: float, keys: Sequence[str] = KEYS, tolerance: float = 1e-9) -> DataFrame:
    """Rows with an energy of at most the batch's least plus the window; an infinite window keeps all.

    The least is aggregated before the join, so a large batch is never in one task.
    """
    if window == float("inf"):
        return structures
    least = structures.groupBy(*keys).agg(F.min("energy").alias("_least"))
    return join_batch(structures, least, list(keys)).where(F.col("energy") <= F.col("_least") + window + tolerance).drop("_least")


def distinct_capped(structures: DataFrame, cap: int, keys: Sequence[str] = KEYS, order: str = "ord") -> DataFrame:
    """The first row of each distinct non-empty structure, and of these the first `cap` of each batch by order."""
    columns = structures.columns
    first = structures.where(F.length("structure") > 0).groupBy(*keys, "structure").agg(F.min_by(F.struct(*columns), F.col(order)).alias("_row")).select("_row.*")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return first.withColumn("_rank", rank).where(F.col("_rank") <= cap).drop("_rank")


def dotbracket_pairs(structure: Column, strict: bool = True) -> Column:
    """Sorted pairs (i, j) of a dot-bracket string by a fold with a stack; other characters are unpaired.

    A closing bracket without an opening one is an error, or, if not strict, gives null.
    """
    kind = "struct<open:array<int>,pairs:array<struct<i:int,j:int>>,bad:boolean>"
    start = F.struct(F.array().cast("array<int>").alias("open"), F.array().cast("array<struct<i:int,j:int>>").alias("pairs"), F.lit(False).alias("bad"))
    chars = F.transform(F.split(structure, ""), lambda c, k: F.struct(c.alias("c"), k.alias("k")))  # made once, not at each step

    def step(acc, x):
        c, k = x["c"], x["k"]
        n = F.size(acc["open"])
        pushed = F.struct(F.concat(acc["open"], F.array(k)).alias("open"), acc["pairs"].alias("pairs"), acc["bad"].alias("bad"))
        pair = F.struct(F.get(acc["open"], n - 1).alias("i"), k.alias("j"))
        popped = F.struct(F.slice(acc["open"], F.lit(1), F.greatest(n - 1, F.lit(0))).alias("open"), F.concat(acc["pairs"], F.array(pair)).alias("pairs"), acc["bad"].alias("bad"))
        broken = F.struct(acc["open"].alias("open"), acc["pairs"].alias("pairs"), F.lit(True).alias("bad"))
        return F.when(c == "(", pushed).when((c == ")") & (n > 0), popped).when(c == ")", broken).otherwise(acc).cast(kind)

    done = F.aggregate(chars, start.cast(kind), step)
    sorted_pairs = F.array_sort(done["pairs"])
    wrong = F.raise_error(F.concat(F.lit("closing bracket without an opening one: "), structure)).cast("array<struct<i:int,j:int>>") if strict else F.lit(None)
    return F.when(done["bad"], wrong).otherwise(sorted_pairs)


def encode_pairs(structures: DataFrame, pairs: DataFrame, keys: Sequence[str] = KEYS, key: str = "seq_id") -> DataFrame:
    """Adds pair_ids, the sorted numbers of a structure's pairs among the allowed ones; other pairs are dropped.

    structures: keys, ord, pairs (an array); pairs: key, i, j, pair_id.  Both joins are by sorting: rows that `explode` makes are far more
    than the size of a written table of structures or sequences says, and a side that is taken for small would go whole through the driver.
    """
    each = structures.select(*keys, "ord", F.explode_outer("pairs").alias("p")).select(*keys, "ord", F.col("p.i").alias("i"), F.col("p.j").alias("j"))
    found = each.join(pairs.select(key, "i", "j", "pair_id").hint("merge"), [key, "i", "j"], "left")
    sets = found.groupBy(*keys, "ord").agg(F.array_sort(F.collect_list("pair_id")).alias("pair_ids"))
    return structures.join(sets.hint("merge"), [*keys, "ord"])


def dedup_min_energy(structures: DataFrame, keys: Sequence[str] = KEYS, by: str = "pair_ids") -> DataFrame:
    """One row for each set of pairs: the structure of least energy (the first of equal ones), at the first one's place."""
    best = F.min_by(F.struct("structure", "energy"), F.struct("energy", "ord"))
    return structures.groupBy(*keys, by).agg(best.alias("_best"), F.min("ord").alias("ord")).select(*keys, "ord", by, "_best.structure", "_best.energy")


def node_index(states: DataFrame, keys: Sequence[str] = KEYS, order: str = "ord") -> DataFrame:
    """Adds node_id from 0 in the batch's order, and pair_hash, the order-free key of pair_ids. order must tell a batch's rows apart."""
    return ranked(states.withColumn("pair_hash", set_key(F.col("pair_ids"))), "node_id", [order], keys)


def enough_states(states: DataFrame, keys: Sequence[str] = KEYS, least: int = 2) -> DataFrame:
    """Batches of at least so many states; joined by sorting, as there may be as many batches as sequences."""
    counted = states.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    return join_batch(states, counted.hint("merge") if keys else counted, list(keys)).drop("_n")
