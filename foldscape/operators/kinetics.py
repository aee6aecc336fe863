"""Transition rates on the landscape, and distances made from slow modes, as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import ship
from . import triplets
from .structures import KEYS

#: Points of a block whose pairs become rows; rows made at once, about.
SIDE, ROWS = 4096, 65536


def transition_rates(nodes: DataFrame, edges: DataFrame, rt: float, prefactor: float = 1.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, p < q, k_pq and k_qp (over the higher of the two energies) and the symmetric s_pq."""
    a = nodes.select(*keys, F.col("node_id").alias("p"), F.col("energy").alias("gp"))
    b = nodes.select(*keys, F.col("node_id").alias("q"), F.col("energy").alias("gq"))
    e = edges.select(*keys, F.least("src", "dst").alias("p"), F.greatest("src", "dst").alias("q")).join(a, [*keys, "p"]).join(b, [*keys, "q"])
    top = F.greatest("gp", "gq")
    return e.select(
        *keys,
        "p",
        "q",
        (prefactor * F.exp(-(top - F.col("gp")) / rt)).alias("k_pq"),
        (prefactor * F.exp(-(top - F.col("gq")) / rt)).alias("k_qp"),
        (prefactor * F.exp(-F.abs(F.col("gp") - F.col("gq")) / (2 * rt))).alias("s_pq"),
    )


def rate_diagonal(rates: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, p, d: minus the sum of the rates that leave p."""
    out = rates.select(*keys, F.explode(F.array(F.struct(F.col("p"), F.col("k_pq").alias("k")), F.struct(F.col("q").alias("p"), F.col("k_qp").alias("k")))).alias("x"))
    return out.groupBy(*keys, F.col("x.p").alias("p")).agg((-F.sum("x.k")).alias("d"))


def spectral_gap_filter(modes: DataFrame, threshold: float, keys: Sequence[str] = ()) -> DataFrame:
    """Adds rank (by absolute eigenvalue, from 0), num_noise and physical: modes ahead of the first gap over the threshold are noise, without a gap one."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    size = F.abs("eigenvalue")
    order = w.orderBy(size, "mode")
    before = F.lag(size).over(order)
    ratio = F.when(before.isNull(), F.lit(0.0)).when(before < 1e-30, F.when(size > 1e-30, F.lit(float("inf"))).otherwise(F.lit(1.0))).otherwise(size / before)
    ranked = modes.withColumns({"rank": F.row_number().over(order) - 1, "_ratio": ratio})
    noise = F.coalesce(F.min(F.when(F.col("_ratio") > threshold, F.col("rank"))).over(w), F.lit(1))
    return ranked.withColumn("num_noise", noise).withColumn("physical", F.col("rank") >= F.col("num_noise")).drop("_ratio")


def basin_vectors(members: DataFrame, rt: float, keys: Sequence[str] = KEYS, group: str = "comp_id", least: DataFrame | None = None) -> DataFrame:
    """keys, group, basin_id, node_id, chi = sqrt(w) / sum of the basin's w, with w from the group's least energy (or least, with _e0)."""
    if least is None:
        least = members.groupBy(*keys, group).agg(F.min("energy").alias("_e0"))
    w = members.join(least, [c for c in (*keys, group) if c in least.columns]).withColumn("_w", F.exp(-(F.col("energy") - F.col("_e0")) / rt))
    total = w.groupBy(*keys, group, "basin_id").agg(F.sum("_w").alias("_total"))
    chi = F.when(F.col("_total") > 0, F.sqrt("_w") / F.col("_total")).otherwise(F.lit(0.0))
    return w.join(total, [*keys, group, "basin_id"]).select(*keys, group, "basin_id", "node_id", chi.alias("chi"))


def project_arrays(vectors: DataFrame, modes: DataFrame, number: int, keys: Sequence[str] = KEYS, group: str = "comp_id", shared: bool = False) -> DataFrame:
    """`project_vectors` with a node's values on all modes (at most number) in one array: modes has keys, group, node_id, v.

    shared: modes has no null_id and serves all samples. Sums are made in each task before anything is shuffled.
    """
    on = [c for c in (*keys, group, "node_id") if not (shared and c == "null_id")]
    sums = F.array(*[F.sum(F.col("chi") * F.get("v", F.lit(k))) for k in range(number)])
    each = vectors.join(modes, on).groupBy(*keys, group, "basin_id").agg(sums.alias("_x"))
    return each.select(*keys, group, "basin_id", F.posexplode("_x").alias("mode", "x")).where("x is not null")


def project_vectors(vectors: DataFrame, modes: DataFrame, keys: Sequence[str] = KEYS, group: str = "comp_id") -> DataFrame:
    """keys, group, basin_id, mode, x = sum over nodes of chi * v: a sparse matrix product. modes: keys, group, mode, node_id, v."""
    return vectors.join(modes, [*keys, group, "node_id"]).groupBy(*keys, group, "basin_id", "mode").agg(F.sum(F.col("chi") * F.col("v")).alias("x"))


def weighted_coordinates(projected: DataFrame, modes: DataFrame, rt: float, prefactor: float = 1.0, keys: Sequence[str] = KEYS, group: str = "comp_id") -> DataFrame:
    """keys, group, id, vector: coordinates scaled by 1 / sqrt|eigenvalue| and RT sqrt(prefactor). modes: keys, group, mode, eigenvalue, of physical modes."""
    scale = rt * prefactor**0.5
    x = projected.join(modes.select(*keys, group, "mode", "eigenvalue"), [*keys, group, "mode"]).withColumn("x", F.col("x") / F.sqrt(F.abs("eigenvalue")) * scale)
    return x.groupBy(*keys, group, F.col("basin_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("mode", "x"))), lambda s: s["x"]).alias("vector"))


def distance_tiles(points: DataFrame, keys: Sequence[str] = KEYS, group: str = "comp_id") -> DataFrame:
    """keys, group and a tile (triplets.TILE) of Euclidean distances for each two blocks of a group's points: no task has more than two blocks.

    points: keys, group, id, vector, of the same length in a group; points without a vector are left out.
    """
    on = [*keys, group]
    ship(points.sparkSession)
    dealt = triplets.dealt_points(points, on, triplets.BLOCK).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = dealt.select(*on, "id", "vector", "blocks", "own", F.least("own", "_other").alias("x"), F.greatest("own", "_other").alias("y"))
    kinds = {f.name: f.dataType.simpleString() for f in points.schema}

    def tile(t: pa.Table) -> pa.Table:
        x, y = t.column("x")[0].as_py(), t.column("y")[0].as_py()
        t = t.sort_by("id")
        own, ids = t.column("own").to_numpy(), t.column("id").to_numpy()
        v = triplets.matrix_of(t)
        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        d = triplets.distances_between(v[left], v[right])
        has = np.ones(d.shape, dtype=np.uint8)
        if x == y:
            np.fill_diagonal(has, 0)
        cells = {"x": x, "y": y, "blocks": t.column("blocks")[0].as_py(), "left": ids[left].tolist(), "right": ids[right].tolist(), "d": d.tobytes(), "has": has.tobytes()}
        return pa.table([*(t.column(c).slice(0, 1) for c in on), *(pa.array([c], type=k) for c, k in zip(cells.values(), triplets._KINDS, strict=True))], names=[*on, *cells])

    return met.groupBy(*on, "x", "y").applyInArrow(tile, ", ".join(f"`{c}` {kinds[c]}" for c in on) + ", " + triplets.TILE)


def pairs_of_tiles(tiles: DataFrame, keys: Sequence[str] = KEYS, group: str = "comp_id") -> DataFrame:
    """keys, group, a < b, d of each pair in tiles."""
    on = [*keys, group]
    kinds = {f.name: f.dataType.simpleString() for f in tiles.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1)
                left, right = (np.array(r.column(c)[0].as_py(), dtype=np.int64) for c in ("left", "right"))
                has = np.frombuffer(r.column("has")[0].as_py(), dtype=np.uint8).reshape(len(left), len(right)).astype(bool)
                if r.column("x")[0] == r.column("y")[0]:
                    has &= left[:, None] < right[None, :]
                i, j = np.nonzero(has)
                a, b = left[i], right[j]
                d = np.frombuffer(r.column("d")[0].as_py()).reshape(has.shape)[i, j]
                same = pa.array(np.zeros(len(i), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([*(r.column(c).take(same) for c in on), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(d)], [*on, "a", "b", "d"])

    return tiles.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in on) + ", a long, b long, d double")


def pairwise_distances(points: DataFrame, keys: Sequence[str] = KEYS, group: str = "comp_id") -> DataFrame:
    """keys, group, a < b, d: Euclidean distances of the vectors in a group.

    Each two blocks of SIDE points meet in one task, which makes the pairs of some points after another: a point is sent to as many
    tasks as there are such blocks, and no task holds the distances of two blocks.
    """
    on = [*keys, group]
    ship(points.sparkSession)
    dealt = triplets.dealt_points(points, on, SIDE).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = dealt.select(*on, "id", "vector", "own", F.least("own", "_other").alias("x"), F.greatest("own", "_other").alias("y"))
    kinds = {f.name: f.dataType.simpleString() for f in points.schema}

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        first, x, y = t.slice(0, 1).combine_chunks(), t.column("x")[0].as_py(), t.column("y")[0].as_py()
        own, ids, v = t.column("own").to_numpy(), t.column("id").to_numpy(), triplets.matrix_of(t)
        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        step = max(1, ROWS // max(1, len(right)))
        for k in range(0, len(left), step):
            some = left[k : k + step]
            d = triplets.distances_between(v[some], v[right])
            i, j = np.nonzero(ids[some][:, None] < ids[right][None, :] if x == y else np.ones(d.shape, dtype=bool))
            a, b = ids[some[i]], ids[right[j]]
            same = pa.array(np.zeros(len(i), dtype=np.int64))
            yield pa.RecordBatch.from_arrays([*(first.column(c).chunk(0).take(same) for c in on), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(d[i, j])], [*on, "a", "b", "d"])

    return met.groupBy(*on, "x", "y").applyInArrow(pairs, ", ".join(f"`{c}` {kinds[c]}" for c in on) + ", a long, b long, d double")
