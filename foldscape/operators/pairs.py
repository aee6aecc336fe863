"""Allowed base pairs of sequences, and conflicts between pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import COMPLEMENTARY
from ..storage import ship

_LETTERS = sorted({x[0] for x in COMPLEMENTARY})


def allowed_pairs(sequences: DataFrame, min_hairpin: int = 3, key: str = "seq_id", seq: str = "seq") -> DataFrame:
    """key, i, j (from 0) of all complementary places with j > i + min_hairpin.

    Each place i makes its own row before the places j are tried: no join, no shuffle, and memory in proportion to one sequence.
    """
    starts = _letters(sequences, min_hairpin, key, seq).withColumn("i", F.explode(F.sequence(F.lit(0), F.size("letters") - min_hairpin - 2)))
    return starts.select(key, "i", F.explode(_fits(F.col("i"), min_hairpin)).alias("j"))


def indexed_pairs(sequences: DataFrame, min_hairpin: int = 3, key: str = "seq_id", seq: str = "seq") -> DataFrame:
    """`allowed_pairs` with pair_id, the numbers of `pair_index`: the pairs of each place i are counted first, so a pair's number is
    that of its place's first one plus its own among them. No shuffle and no sort: memory stays in proportion to one sequence."""
    places = _letters(sequences, min_hairpin, key, seq)
    counts = F.transform(F.sequence(F.lit(0), F.size("letters") - min_hairpin - 2), lambda i: F.size(_fits(i, min_hairpin)))
    ahead = F.aggregate("counts", F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    starts = places.withColumn("counts", counts).select(key, "letters", *[f"_to_{x}" for x in _LETTERS], F.posexplode(ahead).alias("i", "begin")).where(F.col("i") < F.size("letters") - min_hairpin - 1)
    return starts.select(key, "i", "begin", F.posexplode(_fits(F.col("i"), min_hairpin)).alias("_at", "j")).select(key, "i", "j", (F.col("begin") + F.col("_at")).alias("pair_id"))


def _letters(sequences: DataFrame, min_hairpin: int, key: str, seq: str) -> DataFrame:
    """key and the letters of sequences that are long enough for a pair, and for each letter the places that it may pair with."""
    letters = F.filter(F.split(F.col(seq), ""), lambda x: x != "")
    found = sequences.select(F.col(key), letters.alias("letters")).where(F.size("letters") > min_hairpin + 1)
    for x in _LETTERS:
        fits = [y[1] for y in COMPLEMENTARY if y[0] == x]
        found = found.withColumn(f"_to_{x}", F.array_compact(F.transform("letters", lambda c, j: F.when(c.isin(*fits), j))))  # noqa: B023
    return found


def _fits(i: Column, min_hairpin: int) -> Column:
    """The places that the letter at place i may pair with, ascending."""
    mine = F.get("letters", i)
    places = F.array().cast("array<int>")
    for x in _LETTERS:
        places = F.when(mine == x, F.col(f"_to_{x}")).otherwise(places)
    return F.filter(places, lambda j: j > i + min_hairpin)


def pair_index(pairs: DataFrame, key: str = "seq_id") -> DataFrame:
    """Adds pair_id: the place of a pair in its sequence's order by i, then j. For tables of pairs; `indexed_pairs` numbers those of sequences."""
    return pairs.withColumn("pair_id", F.row_number().over(Window.partitionBy(key).orderBy("i", "j")) - 1)


def shared_conflicts(pairs: DataFrame, key: str = "seq_id") -> DataFrame:
    """key, pair_a < pair_b of indexed pairs that have a place in common: an equi-join on the place."""
    ends = pairs.select(key, "pair_id", F.explode(F.array("i", "j")).alias("place"))
    a, b = ends.withColumnRenamed("pair_id", "pair_a"), ends.withColumnRenamed("pair_id", "pair_b")
    return a.join(b, [key, "place"]).where("pair_a < pair_b").select(key, "pair_a", "pair_b")


def crossing_conflicts(pairs: DataFrame, key: str = "seq_id", block: int = 32) -> DataFrame:
    """key, pair_a < pair_b of indexed pairs that cross: i_a < i_b < j_a < j_b.

    A pair meets those that begin inside it, by blocks of places: a long sequence is many keys, and pairs that begin elsewhere never meet.
    """
    a = pairs.select(key, F.col("pair_id").alias("pair_a"), F.col("i").alias("ia"), F.col("j").alias("ja")).withColumn("_block", F.explode(F.sequence(F.floor((F.col("ia") + 1) / block), F.floor((F.col("ja") - 1) / block))))
    b = pairs.select(key, F.col("pair_id").alias("pair_b"), F.col("i").alias("ib"), F.col("j").alias("jb"), F.floor(F.col("i") / block).alias("_block"))
    return a.join(b, [key, "_block"]).where("ia < ib and ib < ja and ja < jb").select(key, "pair_a", "pair_b")


#: The place j of what ends in later blocks.
_LATER = (1 << 31) - 1


def _crossing(i: np.ndarray, j: np.ndarray, n: np.ndarray, s: np.ndarray) -> tuple[int, int, int]:
    """n, sum_a, sum_b of the crossings of pairs (i, j) with numbers s; a row with n at _LATER stands for n pairs that begin at i, s their sum.

    Those that a pair crosses begin between its ends and end behind it: a table of what begins before a place and ends behind another
    has them as a difference of two entries.
    """
    own = j < _LATER
    places, at = np.unique(i, return_inverse=True)
    ends = np.unique(j[own])
    behind = np.searchsorted(ends, j)
    before = np.zeros((2, len(places) + 1, len(ends) + 1), dtype=np.int64)
    np.add.at(before[0], (at + 1, behind), n)
    np.add.at(before[1], (at + 1, behind), s)
    before = np.cumsum(np.cumsum(before[:, :, ::-1], axis=2)[:, :, ::-1][:, :, 1:], axis=1)
    to, since, end = np.searchsorted(places, j[own]), at[own] + 1, behind[own]
    some = np.maximum(to, since)
    count, total = before[:, some, end] - before[:, since, end]
    return int(count.sum()), int((count * s[own]).sum()), int(total.sum())


def _crossing_small(group: np.ndarray, i: np.ndarray, j: np.ndarray, s: np.ndarray, groups: int) -> np.ndarray:
    """The same (a row for each of the groups) for many short sequences at once, each with a table of its places."""
    w = int(j.max()) + 1
    table = np.zeros((w + 1, 2, groups, w), dtype=np.int64)  # of what begins before a place and ends at another or before it
    at = (group * w + j) + (i + 1) * (2 * groups * w)
    flat = table.ravel()
    np.add.at(flat, at, 1)
    np.add.at(flat, at + groups * w, s)
    np.cumsum(table, axis=3, out=table)
    for x in range(1, w + 1):
        table[x] += table[x - 1]
    flat = table.ravel()

    def between(k: int, end: np.ndarray) -> np.ndarray:
        spot = (k * groups + group) * w + end
        return flat[j * (2 * groups * w) + spot] - flat[(i + 1) * (2 * groups * w) + spot]

    count, total = (between(k, w - 1) - between(k, j) for k in range(2))
    out = np.zeros((groups, 3), dtype=np.int64)
    for k, v in enumerate((count, count * s, total)):
        np.add.at(out[:, k], group, v)
    return out


def crossing_counts(pairs: DataFrame, key: str = "seq_id", block: int = 512) -> DataFrame:
    """key, n, sum_a, sum_b: how many crossings `crossing_conflicts` lists for a key, and the sums of pair_a and pair_b, by counting.

    Work grows with the places squared, not with the pairs squared. The pairs of a key that end in one block of places are counted together, with
    a row for each place where pairs of later blocks begin; tasks go through their keys in order, and hold one block's pairs.
    """
    ship(pairs.sparkSession)
    of = lambda c: F.floor(F.col(c) / block)
    own = pairs.where(F.col(key).isNotNull()).select(key, of("j").alias("_block"), F.col("i").cast("long"), F.col("j").cast("long"), F.lit(1).cast("long").alias("n"), F.col("pair_id").cast("long").alias("s"))
    far = own.where(F.col("_block") > of("i")).groupBy(key, "_block", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    far = far.withColumn("_block", F.explode(F.sequence(of("i"), F.col("_block") - 1))).groupBy(key, "_block", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    rows = own.unionByName(far.withColumn("j", F.lit(_LATER).cast("long"))).repartition(key, "_block").sortWithinPartitions(key, "_block")

    def counted(t: pa.Table, starts: list[int]) -> pa.RecordBatch:
        i, j, n, s = (t.column(c).to_numpy() for c in ("i", "j", "n", "s"))
        bounds = np.array(starts)
        small = np.maximum.reduceat(j, bounds[:-1]) < 64
        found = np.zeros((len(small), 3), dtype=np.int64)
        group = np.repeat(np.arange(len(small)), np.diff(bounds))
        for at in range(0, len(small), 256):
            some = np.flatnonzero(small[at : at + 256]) + at
            if len(some):
                r = np.arange(bounds[at], bounds[min(at + 256, len(small))])
                r = r[small[group[r]]]
                found[some] = _crossing_small(np.searchsorted(some, group[r]), i[r], j[r], s[r], len(some))
        for g in np.flatnonzero(~small):
            r = slice(bounds[g], bounds[g + 1])
            found[g] = _crossing(i[r], j[r], n[r], s[r]) if (j[r] < _LATER).any() else 0
        keys = t.column(key).combine_chunks().take(pa.array(starts[:-1], pa.int64()))
        return pa.RecordBatch.from_arrays([keys, *(pa.array(np.ascontiguousarray(found[:, k])) for k in range(3))], [key, "n", "sum_a", "sum_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []  # of the last key and block, which may go on
        for b in batches:
            if not b.num_rows:
                continue
            waiting.append(b)
            same = lambda x, y: x.column(key)[0] == y.column(key)[-1] and x.column("_block")[0] == y.column("_block")[-1]
            if same(waiting[0], b):
                continue
            t = pa.Table.from_batches(waiting).combine_chunks()
            k, o = (t.column(c).combine_chunks() for c in (key, "_block"))
            new = pc.or_(pc.not_equal(k[1:], k[:-1]), pc.not_equal(o[1:], o[:-1])).to_numpy(zero_copy_only=False)
            starts = [0, *(np.flatnonzero(new) + 1).tolist()]
            yield counted(t, starts)
            waiting = t.slice(starts[-1]).to_batches()
        if waiting:
            t = pa.Table.from_batches(waiting)
            yield counted(t, [0, t.num_rows])

    kind = dict(pairs.dtypes)[key]
    parts = rows.mapInArrow(run, f"`{key}` {kind}, n long, sum_a long, sum_b long")
    return parts.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("n", "sum_a", "sum_b")]).where("n > 0")


def pair_conflicts(pairs: DataFrame, key: str = "seq_id") -> DataFrame:
    """Both kinds of conflict, by kind; no two pairs conflict in both."""
    return shared_conflicts(pairs, key).withColumn("kind", F.lit("shared")).unionByName(crossing_conflicts(pairs, key).withColumn("kind", F.lit("crossing")))
