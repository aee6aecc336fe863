"""What large tables asked for: no growing side is broadcast, exact spreads, counts of triplets by ranks."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldscape import queries
from foldscape.functions import whole_std
from foldscape.operators import kinetics, pairs, sweep, triplets
from foldscape.params import Params


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["pairset_encode", "structure_dedup_min_energy", "node_index", "enough_states"])
def test_pairs_and_structures_are_not_broadcast(spark, sf, name):
    """A small file of sequences says nothing of the rows that its pairs are."""
    assert "Broadcast" not in plan(queries.QUERIES[name](spark, sf))


def test_pairs_are_numbered_without_a_shuffle(spark):
    rng = np.random.RandomState(1)
    texts = ["".join(rng.choice(list("ACGU"), n)) for n in (*range(12), 40, 75)]
    s = spark.createDataFrame([*enumerate(texts), (99, None)], "seq_id int, seq string")
    got = pairs.indexed_pairs(s)
    assert "Exchange" not in plan(got)
    rows = lambda df: sorted(tuple(r) for r in df.select("seq_id", "i", "j", "pair_id").collect())
    assert rows(got) == rows(pairs.pair_index(pairs.allowed_pairs(s))) and got.count() > 100


def test_spreads_of_a_half(spark):
    """Standard deviations of just k + 1/2, which sums in floating point miss in some orders of the rows."""
    halves = {13.5: [8, 12, 42, 4, 12, 30, 37, 15, 26], 15.5: [36, 50, 4, 39, 31, 9, 28, 43, 33, 1, 47, 34, 48, 14, 25, 36], 0.5: [0, 0, 0, 1]}
    rng = np.random.RandomState(5)
    rows = [(half, k, int(x)) for half, v in halves.items() for k in range(60) for x in rng.permutation(v)] + [(0.0, 0, 7)]
    got = spark.createDataFrame(rows, "half double, k int, x int").repartition(7).groupBy("half", "k").agg(whole_std(F.col("x")).alias("s")).collect()
    assert len(got) == 181 and all(r.s == round(r.half) for r in got)
    assert spark.range(0).agg(whole_std(F.col("id")).alias("s")).first().s is None


@pytest.mark.parametrize(("block", "strip", "thirds"), [(256, 256, 512), (9, 4, 3), (50, 3, 7), (5, 2, 64)])
def test_triangles_by_ranks(spark, monkeypatch, block, strip, thirds):
    """Counts against all triangles one at a time, with equal sides, sides at the very limits, copies of points, and missing pairs."""
    for name, v in {"BLOCK": block, "STRIP": strip, "THIRDS": thirds, "LISTED": block}.items():
        monkeypatch.setattr(triplets, name, v)
    p = Params(min_basin_size=2)
    rng = np.random.RandomState(8)
    cells = np.array([0.0, 1e-9, 1.0, 0.9, 1.05, np.nextafter(1.05, 2), np.nextafter(0.9, 0), 2.0, 2.1, np.nan, np.inf, 1.9])
    table = [(g, 2 * a + g, 2 * b + g, None if k == 3 else float(d)) for g in (0, 1) for a, b in combinations(range(21), 2) for k, d in [(rng.randint(60), rng.choice(cells))] if k]
    known = {(g, a, b): math.nan if d is None else d for g, a, b, d in table}
    want, rows = {}, []
    for g in (0, 1):
        for i, j, k in combinations([2 * a + g for a in range(21)], 3):
            sides = [known.get((g, *e)) for e in ((i, j), (i, k), (j, k))]
            if None not in sides:
                want[g] = want.get(g, 0) + triplets.label_counts(*map(np.array, sides), p)
                rows.append((g, i, j, k, *map(str, sides)))
    t = spark.createDataFrame(table, "comp_id int, a long, b long, d double")
    got = triplets.score_tiles(triplets.tiles_of(t, []), p, []).collect()
    assert {r.comp_id: [r.n_nontrivial, r.n_trivial, r.n_non] for r in got} == {g: n.tolist() for g, n in want.items()}
    found = triplets.triplets(t, []).collect()
    assert sorted((*r[:4], *(str(math.nan if x is None else x) for x in r[4:])) for r in found) == sorted(rows)
    nulls = {(g, a, b) for g, a, b, d in table if d is None}
    assert {(r.comp_id, r.i, r.k) for r in found if r.d_ik is None} <= nulls and any(r.d_ik is None for r in found)
    points = [(int(k % 2), k, [float(x) for x in rng.randint(0, 3, 2)]) for k in range(40)]
    t = spark.createDataFrame(points, "comp_id int, id long, vector array<double>")
    tiles = triplets.score_tiles(kinetics.distance_tiles(t, []), p, []).collect()
    assert sorted(triplets.score_points(t, p, []).collect()) == sorted(tiles)
    labels = triplets.classify_triplets(triplets.triplets(kinetics.pairwise_distances(t, []), []), p).groupBy("comp_id", "label").count().collect()
    counts = {(r.comp_id, x): r[f"n_{x.removesuffix('_ultrametric')}"] for r in tiles for x in ("nontrivial", "trivial", "non_ultrametric")}
    assert {(r.comp_id, r.label): r["count"] for r in labels} == {k: v for k, v in counts.items() if v}


def test_triplets_are_not_shuffled(spark, sf):
    """Joins on shared points send all rows of two sides, some third of the triplets' own number to each other, through a shuffle."""
    for name in ("triplet_enumeration", "triangle_classify"):
        assert "SortMergeJoin" not in plan(queries.QUERIES[name](spark, sf)).split("FlatMapGroupsInArrow")[0]
    assert "InArrow" not in plan(queries.QUERIES["f_inter"](spark, sf))


def test_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(kinetics, "SIDE", 6)
    monkeypatch.setattr(kinetics, "ROWS", 7)
    rng = np.random.RandomState(3)
    points = [(g, int(k), [float(x) for x in rng.rand(3)]) for g, n in ((0, 40), (1, 2), (2, 1)) for k in rng.choice(1000, n, replace=False)] + [(0, 5000, None)]
    t = spark.createDataFrame(points, "comp_id int, id long, vector array<double>")
    got = {(r.comp_id, r.a, r.b): r.d for r in kinetics.pairwise_distances(t, []).collect()}
    want = {(g, a, b): math.dist(x, y) for g, a, x in points for h, b, y in points if g == h and a < b and x and y}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)
    assert len(triplets.dealt_points(t, ["comp_id"], kinetics.SIDE).select("comp_id", "own").distinct().where("comp_id = 0").collect()) == 7


@pytest.mark.parametrize(("batch", "together", "looked_at"), [(512, 64, 32), (7, 2, 10**9), (7, 2, 12), (16, 3, 0)])
def test_triangles_by_length(monkeypatch, batch, together, looked_at):
    """Counts of edges in batches against all triangles one at a time: copies, ties, sides at the very limits, and edges left to ranks."""
    for name, v in {"BATCH": batch, "TOGETHER": together, "LOOKED_AT": looked_at}.items():
        monkeypatch.setattr(sweep, name, v)
    p = Params(min_basin_size=2)
    rng = np.random.RandomState(4)
    lattice = rng.randint(0, 4, (60, 3)) * 1.0
    cloud = rng.standard_normal((60, 8))
    odd = np.concatenate([cloud[:20], cloud[:20], 1e6 * cloud[:10], [[np.nan] * 8, [np.inf] * 8]])
    grid = np.round(rng.rand(60, 1) * 40) / 20
    for points in (lattice, cloud, odd, grid, np.zeros((30, 2)), np.exp(9 * rng.standard_normal((60, 2)))):
        parts = np.sort(rng.randint(0, 3, len(points)))
        d = triplets.distances_between(points, points)
        d = np.where(np.triu(np.ones(d.shape, dtype=bool)), d, d.T)
        side = lambda a, b, d=d, parts=parts: (d[np.ix_(parts == a, parts == b)], (~np.eye(len(d), dtype=bool))[np.ix_(parts == a, parts == b)].astype(np.uint8))
        for three in ((0, 1, 2), (0, 0, 1), (0, 1, 1), (2, 2, 2)):
            found = [t for t in combinations(range(len(points)), 3) if sorted(parts[list(t)]) == list(three)]
            i, j, k = np.array(found).T
            assert triplets._triangles(three, side, p).tolist() == triplets.label_counts(d[i, j], d[i, k], d[j, k], p).tolist()


def test_lengths_in_order():
    """The bits that places take from numbers don't change their order, and equal numbers are in order of their places."""
    rng = np.random.RandomState(2)
    d = 1 + rng.randint(0, 50, (300, 70)) * 2.0**-50
    d[3, 5], d[9, 9], d[0, 1], d[7, 7] = np.nan, np.inf, -0.0, 0.0
    values, rows, columns = sweep.ordered(d, False)
    want = sorted((x, i, j) for (i, j), x in np.ndenumerate(d) if x < np.inf)
    assert list(zip(values, rows, columns, strict=True)) == want
    assert len(sweep.ordered(np.ones((5, 5)), True)[0]) == 10


def test_scores_store_no_distances_and_rank_no_edges(spark, sf, monkeypatch):
    """A table of distances grows with the square of the points; ranks of each edge took three times as long as sets by length."""
    wrote = []
    monkeypatch.setattr(queries, "kept", lambda df, name: wrote.append(name) or df)
    assert queries.kernel_scores(spark, sf).count() == queries.ultrametricity_score(spark, sf).count() and not wrote
    monkeypatch.setattr(triplets, "_edges", None)
    monkeypatch.setattr(sweep, "BATCH", 64)
    cloud = np.random.RandomState(6).standard_normal((300, 8))
    d = triplets.distances_between(cloud, cloud)
    np.fill_diagonal(d, 0)
    got = triplets._triangles((0, 0, 0), lambda a, b: (d, 1 - np.eye(300, dtype=np.uint8)), Params())
    assert got.sum() == math.comb(300, 3) and got.min() > 0


def test_near_points_keep_their_digits():
    rng = np.random.RandomState(1)
    a = 1000 + rng.rand(20, 5)
    b = np.concatenate([a, a + 1e-9])
    want = np.array([[math.dist(x, y) for y in b] for x in a])
    got = triplets.distances_between(a, b)
    assert np.allclose(got, want, rtol=1e-12, atol=0) and (got[np.arange(20), np.arange(20)] == 0).all()


@pytest.mark.parametrize("block", [256, 7])
def test_triplets_leave_their_task_as_they_are_wanted(spark, sf, monkeypatch, block):
    """Labels and rounded sums are made of arrays where the rows are, not row by row behind them."""
    monkeypatch.setattr(triplets, "LISTED", block)
    p = Params()
    rng = np.random.RandomState(3)
    cells = [0.0, 1.0, 1.02, 0.8, 2.5, math.nan, math.inf, None, 1.000004, 2.4999949]
    table = [(g, a, b, cells[rng.randint(len(cells))]) for g in (1, 2) for a, b in combinations(rng.permutation(40)[:25].tolist(), 2) if rng.rand() < 0.95]
    t = spark.createDataFrame([(g, min(a, b), max(a, b), d) for g, a, b, d in table], "comp_id int, a long, b long, d double")
    want = triplets.classify_triplets(triplets.triplets(t, []), p).collect()
    found = triplets.triplets(t, [], made=triplets.labels(p)).collect()
    assert sorted(found) == sorted((*r[:4], r.label) for r in want) and len({r.label for r in want}) == 3
    assert all(r.i < r.j < r.k for r in want) and len({r[:4] for r in want}) == len(want)
    sums = {tuple(r[:4]): r.around for r in triplets.triplets(t, [], made=triplets.perimeters(5)).collect()}
    for r in want:
        total = sum(math.nan if x is None else x for x in r[4:7])
        assert str(sums[tuple(r[:4])]) == str(round(total, 5)), r
    plans = [plan(queries.QUERIES[x](spark, sf)) for x in ("triplet_enumeration", "triangle_classify")]
    assert not any("CASE WHEN" in x.split("FlatMapGroupsInArrow")[0] or "round(" in x.split("FlatMapGroupsInArrow")[0] for x in plans)


def test_tables_of_slow_modes_are_not_all_kept(spark, monkeypatch):
    """Of the rounds' tables one is left, and what the modes are made of has no other vectors."""
    from foldscape.operators import modes

    monkeypatch.setattr(modes, "BLOCK", 16)
    monkeypatch.setattr(modes, "COARSE", 12)
    there, kept, dropped = [], modes.kept, modes.dropped
    monkeypatch.setattr(modes, "kept", lambda df, name: there.append((name, x := kept(df, name))) or x)
    monkeypatch.setattr(modes, "dropped", lambda df: there.remove(next(t for t in there if t[1] is df)) or dropped(df))
    n = 60
    nodes = spark.createDataFrame([(0, k, 0.0) for k in range(n)], "comp_id int, node_id long, energy double")
    edges = spark.createDataFrame([(0, k, k + 1) for k in range(n - 1)], "comp_id int, src long, dst long")
    values = modes.slow_modes(nodes, edges, 3, 1.0, keys=[])[0].first().eigenvalues
    assert np.allclose(values[1:], [2 * math.cos(math.pi * k / n) - 2 for k in (1, 2)], rtol=1e-8)
    assert sum(name == "state" for name, _ in there) == 1
    assert all(r.ad is None and r.aw is None for name, x in there if name == "done" for r in x.collect())
