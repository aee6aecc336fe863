"""Hand-checked cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldscape.functions import half_even, triangle_label
from foldscape.operators import basins, components, kinetics, modes, neighbors, nulls, pairs, stats, structures, triplets
from foldscape.operators.sampler import Fold, sample, sample_structures, structure_energy
from foldscape.params import Params
from foldscape.plans import analysis
from foldscape.plans import report as reporting
from foldscape.sources import fasta

P = Params(min_basin_size=1, alpha=0.0)
RT = P.rt


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def nodes_of(spark, energies):
    return spark.createDataFrame([(k, float(e)) for k, e in enumerate(energies)], "node_id long, energy double")


def edges_of(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


def dense(energies, edges, prefactor=1.0):
    """The symmetric rate matrix, entry by entry."""
    out = np.zeros((len(energies), len(energies)))
    for a, b in edges:
        top = max(energies[a], energies[b])
        out[a, b] = out[b, a] = prefactor * math.exp(-abs(energies[a] - energies[b]) / (2 * RT))
        for x in (a, b):
            out[x, x] -= prefactor * math.exp(-(top - energies[x]) / RT)
    return out


def test_params_are_checked():
    assert math.isclose(RT, 0.61633140092885)
    for bad in ({"epsilon": 0.2, "delta": 0.1}, {"temperature_celsius": 101.0}, {"null_model": "other"}, {"energy_window": 0.0}, {"num_runs": 0}):
        with pytest.raises(ValueError):
            Params(**bad)


def test_fasta(spark, tmp_path):
    text = ">a one\nACGTacgtNN\nAC\n>b short\nACG\n>c\r\nGGGAAACCCU"
    one = spark.createDataFrame([(1, text)], "file_id int, t string")
    parsed = fasta.parse_records(fasta.split_fasta(one, "file_id", "t"))
    assert [(r.seq, r.description, r.length) for r in fasta.by_length(fasta.accepted(parsed), "ordinal").collect()] == [("ACGUACGUAC", "a one", 10), ("GGGAAACCCU", "c", 10)]
    assert rows(fasta.rejected(parsed), "description", "reason") == [("b short", "shorter than 10")]
    (tmp_path / "x.fasta").write_text(text)
    (tmp_path / "y.fasta").write_text("")
    (tmp_path / "z.txt").write_text(">no\nACGUACGUACGU")
    read = fasta.accepted(fasta.parse_records(fasta.read_fasta(spark, str(tmp_path))))
    assert rows(read, "seq", "description") == [("ACGUACGUAC", "a one"), ("GGGAAACCCU", "c")]
    assert rows(fasta.literal_sequence(spark, "acgt!"), "seq", "length") == [("ACGU", 4)]


def test_allowed_pairs_and_conflicts(spark):
    s = spark.createDataFrame([(1, "GGGAAACCC"), (2, "ACG"), (3, ""), (4, None)], "seq_id long, seq string")
    p = pairs.pair_index(pairs.allowed_pairs(s)).cache()
    assert rows(p, "seq_id", "i", "j", "pair_id") == [(1, i, j, 3 * i + j - 6) for i in range(3) for j in (6, 7, 8)]
    found = pairs.pair_conflicts(p)
    assert {r.kind: r["count"] for r in found.groupBy("kind").count().collect()} == {"shared": 18, "crossing": 9}


@pytest.mark.parametrize("block", [3, 512])
def test_crossings_are_counted_without_being_listed(spark, block):
    rng = np.random.RandomState(5)
    seqs = [(k, "".join(rng.choice(list("ACGUN"), n))) for k, n in enumerate([3, 4, 5, 9, 17, 40, 90])] + [(99, "A" * 20), (None, "ACGUACGUACGU")]
    p = pairs.indexed_pairs(spark.createDataFrame(seqs, "seq_id int, seq string")).cache()
    named = p.where("seq_id is not null")
    assert rows(named, "seq_id", "i", "j", "pair_id") == rows(pairs.pair_index(named.drop("pair_id")), "seq_id", "i", "j", "pair_id")
    want = pairs.crossing_conflicts(p).groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"), F.sum("pair_a").alias("sum_a"), F.sum("pair_b").alias("sum_b"))
    got = rows(pairs.crossing_counts(p, block=block), "seq_id", "n", "sum_a", "sum_b")
    assert len(got) >= 3 and got == rows(want, "seq_id", "n", "sum_a", "sum_b")


STRUCTURES = ["(((...)))", "((.....))", ".((...)).", ".........", "(.......)", "..(...)..", "(.(...).)"]
SETS = [[2, 4, 6], [2, 4], [4, 6], [], [2], [6], [2, 6]]
EDGES = [(0, 1), (0, 2), (0, 6), (1, 2), (1, 4), (1, 6), (2, 5), (2, 6), (3, 4), (3, 5), (4, 5), (4, 6), (5, 6)]


def test_encoding_and_neighbors(spark):
    seqs = spark.createDataFrame([(1, "GGGAAACCC")], "seq_id long, seq string")
    p = pairs.pair_index(pairs.allowed_pairs(seqs))
    s = spark.createDataFrame([(1, 0, -1, k, x, -float(x.count("("))) for k, x in enumerate(STRUCTURES)], "seq_id long, run_id int, null_id int, ord long, structure string, energy double")
    coded = structures.encode_pairs(s.withColumn("pairs", structures.dotbracket_pairs(F.col("structure"))), p)
    n = structures.node_index(structures.dedup_min_energy(coded)).cache()
    assert [list(r.pair_ids) for r in n.orderBy("node_id").collect()] == SETS
    assert rows(neighbors.neighbor_graph(n), "src", "dst") == EDGES
    assert rows(neighbors.canonical_edges(neighbors.both_ways(neighbors.neighbor_graph(n))), "src", "dst") == EDGES
    c = components.connected_components(n, neighbors.neighbor_graph(n))
    assert rows(c, "node_id", "component", "comp_size") == [(k, 0, 7) for k in range(7)]
    degree = dict(rows(neighbors.degrees(n, neighbors.neighbor_graph(n)), "node_id", "degree"))
    assert degree == {k: sum(k in e for e in EDGES) for k in range(7)}
    states = analysis.states_of(s, seqs, P)
    assert [list(r.pair_ids) for r in states.orderBy("node_id").collect()] == SETS


def test_dotbracket(spark):
    one = spark.createDataFrame([("((..)x.)",), ("",), ("())(",), ("...",), (None,)], "s string")
    got = [r.p for r in one.select(structures.dotbracket_pairs(F.col("s"), strict=False).alias("p")).collect()]
    assert [[tuple(x) for x in p] if p is not None else None for p in got][:4] == [[(0, 7), (1, 4)], [], None, []]
    with pytest.raises(Exception, match="closing bracket"):
        one.where("s = '())('").select(structures.dotbracket_pairs(F.col("s"))).collect()


def test_dedup_window_cap(spark):
    s = spark.createDataFrame([(1, 0, "x", -1.0, [1]), (1, 1, "y", -2.0, [1]), (1, 2, "z", -2.0, [1]), (1, 3, "x", 5.0, [2])], "seq_id long, ord long, structure string, energy double, pair_ids array<int>")
    assert rows(structures.dedup_min_energy(s, ["seq_id"]), "ord", "structure", "energy") == [(0, "y", -2.0), (3, "x", 5.0)]
    assert rows(structures.energy_window(s, 1.0, ["seq_id"]), "ord") == [(0,), (1,), (2,)]
    assert structures.energy_window(s, math.inf, ["seq_id"]).count() == 4
    assert rows(structures.distinct_capped(s, 2, ["seq_id"]), "ord") == [(0,), (1,)]
    assert structures.enough_states(s.limit(1), ["seq_id"]).count() == 0


@pytest.mark.parametrize(
    ("energies", "edges", "pointers", "found"),
    [
        ([0, 1, 2, 1, 0], [(0, 1), (1, 2), (2, 3), (3, 4)], [None, 0, 1, 4, None], [0, 0, 0, 4, 4]),
        ([1, 1, 0], [(0, 1), (1, 2)], [None, 2, None], [0, 2, 2]),
        ([0, 0, 1, 5], [(0, 1), (1, 2)], [None, None, 1, None], [0, 0, 0, 3]),
        ([2, 1, 1, 2], [(0, 1), (1, 2), (2, 3)], [1, None, None, 2], [1, 1, 1, 1]),
    ],
)
def test_basins(spark, energies, edges, pointers, found):
    n, e = nodes_of(spark, energies), edges_of(spark, edges)
    got = basins.descent_pointers(n, e, [])
    assert [r.pointer for r in got.orderBy("node_id").collect()] == pointers
    assert [r.basin_id for r in basins.gradient_basins(n, e, []).orderBy("node_id").collect()] == found


def test_rates_and_weights(spark):
    n, e = nodes_of(spark, [-1, -2]), edges_of(spark, [(0, 1)])
    r = kinetics.transition_rates(n, e, RT, keys=[])
    x = r.first()
    assert math.isclose(x.s_pq, 0.44430151130865936) and x.k_pq == 1 and math.isclose(x.k_qp, 0.19740383295115874)
    d = dict(rows(kinetics.rate_diagonal(r, []), "p", "d"))
    assert math.isclose(d[0], -1) and math.isclose(d[1], -0.19740383295115874)
    assert np.allclose(np.linalg.eigvalsh(dense([-1.0, -2.0], [(0, 1)])), [-1.19740383, 0], atol=1e-8)
    w = basins.basin_weights(nodes_of(spark, [0, 1]).withColumns({"comp_id": F.lit(0), "basin_id": F.lit(0)}), RT, [])
    assert math.isclose(w.first().z, 1.1974038329511587)
    chi = kinetics.basin_vectors(nodes_of(spark, [0, 1]).withColumns({"comp_id": F.lit(0), "basin_id": F.lit(0)}), RT, [])
    assert math.isclose(sum(r.chi**2 for r in chi.collect()) * 1.1974038329511587, 1)


@pytest.mark.parametrize(("values", "noise"), [([1e-17, 1e-3, 2e-3], 1), ([1e-17, 1e-16, 1e-3], 2), ([0, 0, 1e-3], 2), ([0, 1e-3, 2e-3], 1), ([1e-3, 2e-3], 1)])
def test_gap(spark, values, noise):
    modes = spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "mode int, eigenvalue double")
    got = kinetics.spectral_gap_filter(modes, 1e6)
    assert {r.num_noise for r in got.collect()} == {noise}
    assert got.where("physical").count() == len(values) - noise


TRIANGLES = {
    (1, 1, 1): "trivial", (0.5, 1, 1.04): "nontrivial", (1, 1.2, 1.5): "non_ultrametric", (0, 0, 0): "trivial", (0, 1, 1): "nontrivial",
    (0.95, 1, 1.04): "non_ultrametric", (0, 0, 1): "non_ultrametric", (1, 1, math.inf): "non_ultrametric", (1, 1.02, 1.04): "trivial",
    (0.85, 1, 1.05): "non_ultrametric", (1, 1, math.nan): "non_ultrametric",
}


def test_triangles(spark):
    t = spark.createDataFrame([tuple(map(float, k)) for k in TRIANGLES], "a double, b double, c double")
    got = [r.x for r in t.select(triangle_label(F.col("c"), F.col("a"), F.col("b")).alias("x")).collect()]
    assert got == list(TRIANGLES.values())
    for sides, label in TRIANGLES.items():
        assert triplets.label_counts(*map(np.array, sides), P).tolist() == [int(label == x) for x in ("nontrivial", "trivial", "non_ultrametric")]


@pytest.mark.parametrize("block", [256, 7, 1])
def test_scores_by_blocks(spark, monkeypatch, block):
    """Scores from tiles of distances against all triplets, one at a time; with pairs that are missing, null, infinite or no number."""
    monkeypatch.setattr(triplets, "BLOCK", block)
    rng = np.random.RandomState(4)
    points = [(g, int(k), [float(x) for x in rng.randint(0, 5, 3)]) for g, n in ((0, 23), (1, 9), (2, 2), (3, 1)) for k in rng.choice(1000, n, replace=False)]
    t = spark.createDataFrame(points, "comp_id int, id long, vector array<double>")
    d = {(g, min(a, b), max(a, b)): math.dist(x, y) for g, a, x in points for h, b, y in points if g == h and a < b}
    pairs_ = kinetics.pairwise_distances(t, []).collect()
    assert len(pairs_) == len(d) and all(math.isclose(r.d, d[r.comp_id, r.a, r.b], abs_tol=1e-12) for r in pairs_)
    odd = dict(d)
    for k, key in enumerate(sorted(d)):
        if k % 7 == 0:
            del odd[key]
        elif k % 11 == 0:
            odd[key] = [None, math.nan, math.inf][k % 3]
    table = spark.createDataFrame([(*k, v) for k, v in odd.items()], "comp_id int, a int, b int, d double")
    for tiles, known in ((kinetics.distance_tiles(t, []), d), (triplets.tiles_of(table, []), odd)):
        want = {}
        for (g, i, j), ij in known.items():
            for (h, a, k), ik in known.items():
                if (g, i) == (h, a) and j < k and (g, j, k) in known:
                    sides = [math.nan if x is None else x for x in (ij, ik, known[g, j, k])]
                    want[g] = want.get(g, 0) + triplets.label_counts(*map(np.array, sides), P)
        got = {r.comp_id: [r.n_nontrivial, r.n_trivial, r.n_non] for r in triplets.score_tiles(tiles, P, []).collect()}
        assert got == {g: n.tolist() for g, n in want.items()} and len(got) == 2
    assert triplets.score_tiles(kinetics.distance_tiles(t.where("false"), []), P, []).count() == 0


PATH = [0, 1, 2, 1, 0.5, 2, 0.25]


@pytest.mark.parametrize("prefactor", [1.0, 7.0])
def test_kinetic_distance(spark, prefactor):
    p = Params(min_basin_size=1, alpha=0.0, num_modes=50, prefactor=prefactor)
    n = nodes_of(spark, PATH).withColumn("batch", F.lit(0))
    e = edges_of(spark, [(k, k + 1) for k in range(6)]).withColumn("batch", F.lit(0))
    m = analysis.graph_members(n, e, ["batch"])
    found = analysis.analyze_graph(n, e, m, p, ["batch"]).cache()
    r = found.first()
    assert np.allclose(np.array(r.eigenvalues)[1:] / prefactor, [-0.0198449, -0.08091003, -1.10461961, -1.49110668, -2.09341206], atol=1e-7)
    assert r.num_noise_modes == 1 and r.num_phys_modes == 5 and (r.n_nontrivial, r.n_trivial, r.n_non) == (0, 0, 1)
    apart = analysis.component_distances(analysis.component_spectra(n, e, m, p, ["batch"]), ["batch"]).collect()
    named = {frozenset((r.basins[x.a], r.basins[x.b])): x.d for x in apart}
    assert len(named) == len(apart) == 3
    assert np.allclose([named[frozenset(k)] for k in ((0, 4), (0, 6), (4, 6))], [4.589977, 6.365706, 4.316244], atol=1e-6)
    stats_row = analysis.run_stats(found, n, m, p, ["batch"]).first()
    assert stats_row.weighted_u_non == 100 and stats_row.f_inter == 0 and stats_row.total_basins == 3


def solved(spark, energies, edges, k, labels=None):
    """Eigenvalues and vectors (by node) of one component."""
    n = nodes_of(spark, energies).withColumn("comp_id", F.lit(0))
    n = n.withColumn("near", F.lit(0)) if labels is None else n.join(spark.createDataFrame(list(enumerate(labels)), "node_id long, near long"), "node_id")
    values, vectors, failed = modes.slow_modes(n, edges_of(spark, edges).withColumn("comp_id", F.lit(0)), k, RT, keys=[], order=["near"])
    assert failed.count() == 0
    return np.array(values.first().eigenvalues), np.array([r.v for r in vectors.orderBy("node_id").collect()])


@pytest.mark.parametrize(("block", "coarse"), [(1024, 2048), (60, 80)])
def test_slow_modes_are_the_dense_solution(spark, monkeypatch, block, coarse):
    """A graph without any order, as one block and as blocks of which each has a share of the coarse space only."""
    monkeypatch.setattr(modes, "BLOCK", block)
    monkeypatch.setattr(modes, "COARSE", coarse)
    rng = np.random.RandomState(3)
    n = 240
    edges = sorted({(min(a, b), max(a, b)) for a, b in [(k, k + 1) for k in range(n - 1)] + [tuple(map(int, rng.randint(0, n, 2))) for _ in range(300)] if a != b})
    energy = rng.standard_normal(n).tolist()
    values, vectors = np.linalg.eigh(dense(energy, edges))
    values, vectors = values[::-1][:12], vectors[:, ::-1][:, :12]
    got, found = solved(spark, energy, edges, 12)
    assert got[0] == 0 and np.allclose(got[1:], values[1:], rtol=1e-8)
    w = np.exp(-(np.array(energy) - min(energy)) / RT)
    groups = np.array_split(rng.permutation(n), 6)
    place = lambda x, v: np.array([np.sqrt(w[g]) @ x[g, 1:] / w[g].sum() for g in groups]) / np.sqrt(np.abs(v[1:]))
    a, b = place(vectors, values), place(found, got)
    apart = lambda x: np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.allclose(apart(a), apart(b), rtol=1e-5)


def test_slow_modes_of_many_blocks_need_no_coarse_matrix(spark, monkeypatch):
    """A long path with some chords: what a task holds stays as wide as a few blocks' borders, and the modes are the dense solution's."""
    from foldscape.operators import nested

    monkeypatch.setattr(modes, "BLOCK", 64)
    monkeypatch.setattr(modes, "COARSE", 24)
    monkeypatch.setattr(modes._Solver, "coarse", None)
    made, condensed = [], nested.Nested.condensed
    monkeypatch.setattr(nested.Nested, "condensed", lambda self, *a: made.append(self) or condensed(self, *a))
    n = 400
    energy = (0.3 * np.random.RandomState(1).standard_normal(n)).tolist()
    edges = [(k, k + 1) for k in range(n - 1)] + [(k, k + 3) for k in range(0, n - 3, 40)]
    got, vectors = solved(spark, energy, edges, 4)
    want = np.linalg.eigvalsh(-dense(energy, edges))[:4]
    assert got[0] == 0 and np.allclose(-got[1:], want[1:], rtol=1e-8)
    assert np.allclose(vectors.T @ vectors, np.eye(4), atol=1e-9)
    widths = [sum(np.frombuffer(r.widths, "<i4")) for level in made[0].levels for r in level.select("widths").collect()]
    assert len(made[0].levels) > 1 and max(widths) <= 60


def test_slow_modes_of_deep_wells(spark, monkeypatch):
    """Two wells of a path, far below the hill between them: a mode that is some ten orders slower than the rest keeps its digits."""
    monkeypatch.setattr(modes, "BLOCK", 16)
    monkeypatch.setattr(modes, "COARSE", 24)
    energy = [abs(abs(k - 30) - 15) / -1.0 for k in range(61)]
    energy = [-e if e else 0.0 for e in energy]
    edges = [(k, k + 1) for k in range(60)]
    got, _ = solved(spark, energy, edges, 5)
    # the second mode's rate in exact numbers, by bisection on the signs of a Sturm sequence
    from fractions import Fraction

    m = [[Fraction(x) for x in row] for row in (-dense(energy, edges)).tolist()]

    def below(x):
        q, n = Fraction(1), 0
        for k in range(61):
            q = m[k][k] - x - (m[k - 1][k] ** 2 / q if k else 0)
            n += q < 0
            q = Fraction(float(q)) or Fraction(1, 10**30)
        return n

    low, high = Fraction(1, 10**14), Fraction(1)
    for _ in range(60):
        mid = Fraction(float(low * high) ** 0.5)
        low, high = (low, mid) if below(mid) >= 2 else (mid, high)
    assert math.isclose(-got[1], float(high), rel_tol=1e-4)


def test_ranks_of_one_key_with_all_rows(spark):
    from foldscape.storage import ranked

    rng = np.random.RandomState(2)
    values = [(1, int(x)) for x in rng.permutation(3000)] + [(2, 5), (None, 7), (None, 3)]
    t = spark.createDataFrame(values, "k int, x long").repartition(9)
    got = ranked(t, "place", ["x"], ["k"]).collect()
    assert sorted((r.k, r.x, r.place) for r in got if r.k == 1) == [(1, x, x) for x in range(3000)]
    assert sorted((r.x, r.place) for r in got if r.k is None) == [(3, 0), (7, 1)] and [(r.x, r.place) for r in got if r.k == 2] == [(5, 0)]
    assert rows(ranked(t.where("k = 1"), "place", ["x"]).where("x != place"), "x") == []
    assert ranked(t.where("false"), "place", ["x"], ["k"]).count() == 0


def test_scores_over_components(spark):
    c = spark.createDataFrame([(0, 4, 4, 50.0, 50.0, 0.0), (1, 3, 1, 20.0, 80.0, 0.0)], "comp_id int, num_basins int, num_triplets long, u_nt double, u_tr double, u_non double")
    assert math.isclose(triplets.between_share(c, []).first().f_inter, 0.857142857142857)
    assert math.isclose(triplets.weighted_score(c, []).first().weighted_u_nt, 44.0)
    none = triplets.weighted_score(c.where("false"), []).first()
    assert none.total_triplets == 0 and none.weighted_u_nt == 0
    assert triplets.between_share(c.where("comp_id > 5"), []).first().f_inter == 0


def test_statistics(spark):
    s = spark.createDataFrame([(1, float(x)) for x in (1, 2, 3, 4)] + [(2, 5.0)], "k int, u_nt double")
    m = {r.k: (r.mean_u_nt, r.std_u_nt) for r in stats.mean_std(s, ["u_nt"], ["k"]).collect()}
    assert m[1][0] == 2.5 and math.isclose(m[1][1], 1.2909944487358056) and m[2] == (5.0, 0.0)
    real = spark.createDataFrame([(1, 4.0), (2, 5.0)], "k int, real_value double")
    assert dict(rows(stats.two_sided_p(s, real, ["k"]), "k", "p_value")) == {1: 0.5, 2: 1.0}
    h = spark.createDataFrame([(2.5,), (3.5,), (-0.5,)], "x double").select(half_even(F.col("x")).alias("x"))
    assert [r.x for r in h.collect()] == [2, 4, 0]
    assert stats.ensemble_row(s.where("k = 2"), ["u_nt"]).first().std_u_nt == 0


def test_null_models_keep_what_they_must(spark):
    n = nodes_of(spark, range(20)).withColumns({"comp_id": F.lit(0), "basin_id": F.when(F.col("node_id") < 15, (F.col("node_id") / 5).cast("long"))})
    a = nulls.energy_shuffle(n, 3, 1, [])
    for k in range(3):
        got = [r.energy for r in a.where(f"null_id = {k}").orderBy("node_id").collect()]
        assert sorted(got) == list(range(20)) and got != list(range(20))
    assert rows(a, "null_id", "node_id", "energy") == rows(nulls.energy_shuffle(n.repartition(7), 3, 1, []), "null_id", "node_id", "energy")
    ring = [(k, (k + 1) % 20) for k in range(20)] + [(k, (k + 5) % 20) for k in range(20)]
    e = neighbors.canonical_edges(edges_of(spark, ring), [])
    swapped = nulls.topology_shuffle(e, 2, 10, 1, [])
    for k in range(2):
        got = rows(swapped.where(f"null_id = {k}"), "src", "dst")
        assert len(set(got)) == len(got) == 40 and all(x < y for x, y in got) and got != rows(e, "src", "dst")
        assert all(sum(v in x for x in got) == 4 for v in range(20))
    b = nulls.random_basins(n, 2, 1, [])
    for k in range(2):
        assert {r.basin_id: r["count"] for r in b.where(f"null_id = {k}").groupBy("basin_id").count().collect()} == {0: 5, 1: 5, 2: 5, None: 5}
    s = spark.createDataFrame([(1, "AAAACCCCGGGGUUUU")], "seq_id long, seq string")
    got = [r.seq for r in nulls.letter_shuffle(s, 3, 1).orderBy("null_id").collect()]
    assert all(sorted(x) == sorted("AAAACCCCGGGGUUUU") for x in got) and len(set(got)) == 3


def test_places_of_the_null_models(spark):
    """The places of each sample against a slow version: the hashes that the models order by are asked for one at a time."""
    def hashed(*values):
        return spark.range(1).select(F.xxhash64(*values).alias("h")).first().h

    energies = [5.0, 3.0, 8.0, 1.0, 9.0, 2.0]
    n = nodes_of(spark, energies).withColumns({"comp_id": F.lit(0), "basin_id": F.when(F.col("node_id") < 4, (F.col("node_id") / 2).cast("long"))})
    seed = 11
    for k in range(2):
        order = sorted(range(6), key=lambda v: (hashed(F.lit(seed + nulls.ENERGY + k), F.lit(v).cast("long")), v))  # noqa: B023
        got = {r.node_id: r.energy for r in nulls.energy_shuffle(n, 2, seed, []).where(f"null_id = {k}").collect()}
        assert [got[v] for v in range(6)] == [energies[v] for v in order]
        order = sorted(range(6), key=lambda v: (hashed(F.lit(seed + nulls.RANDOM_BASINS + k), F.lit(v).cast("long")), v))  # noqa: B023
        got = {r.node_id: r.basin_id for r in nulls.random_basins(n, 2, seed, []).where(f"null_id = {k}").collect()}
        assert [got[v] for v in order] == [0, 0, 1, 1, None, None]
    text = "ACGUUGCA"
    s = spark.createDataFrame([(7, text)], "seq_id long, seq string")
    for r in nulls.letter_shuffle(s, 2, seed).collect():
        order = sorted(range(8), key=lambda i: (hashed(F.lit(i), F.lit(seed + nulls.LETTERS + r.null_id), F.lit(7).cast("long")), i))  # noqa: B023
        assert r.seq == "".join(text[i] for i in order)


def test_swaps_reach_all_graphs_alike(spark):
    """All graphs with the degrees of a small one, enumerated: 1,500 samples fall on them alike."""
    import itertools

    edges = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (0, 5), (0, 3)]
    degree = lambda g: tuple(sum(v in e for e in g) for v in range(6))
    every = {g for g in itertools.combinations(itertools.combinations(range(6), 2), len(edges)) if degree(g) == degree(edges)}
    swapped = nulls.topology_shuffle(edges_of(spark, edges), 1500, 2, 3, [])
    found = {}
    for r in swapped.groupBy("null_id").agg(F.array_sort(F.collect_list(F.struct("src", "dst"))).alias("g")).collect():
        g = tuple((e["src"], e["dst"]) for e in r.g)
        found[g] = found.get(g, 0) + 1
    assert set(found) <= every and sum(found.values()) == 1500
    expected = 1500 / len(every)
    chi = sum((found.get(g, 0) - expected) ** 2 / expected for g in every)
    free = len(every) - 1
    assert chi < free + 4 * math.sqrt(2 * free), (chi, free)


def test_swaps_that_cannot_be_made(spark, monkeypatch):
    """A complete graph, a star and a single edge stay as they are, beside one that doesn't."""
    monkeypatch.setattr(nulls, "STILL", 2)
    graphs = {1: [(a, b) for a in range(4) for b in range(a)], 2: [(0, k) for k in range(1, 6)], 3: [(0, 1)], 4: [(k, k + 1) for k in range(12)]}
    e = spark.createDataFrame([(g, min(x), max(x)) for g, xs in graphs.items() for x in xs], "g int, src long, dst long")
    got = nulls.topology_shuffle(e, 2, 3, 1, ["g"])
    for g, xs in graphs.items():
        for k in range(2):
            now = rows(got.where(f"g = {g} and null_id = {k}"), "src", "dst")
            assert (now == sorted((min(x), max(x)) for x in xs)) == (g != 4) and len(set(now)) == len(xs)
    assert nulls.topology_shuffle(e.where("false"), 2, 3, 1, ["g"]).count() == 0


def test_sampler():
    seq = "GGGAAACCCAGGCGAAAGCC"
    p = Params(max_structures=300)
    got = dict(sample_structures(seq, p, 1))
    assert got == dict(sample_structures(seq, p, 1))
    best = next(iter(got))
    assert got[best] == min(got.values()) and best.count("(") == best.count(")")
    assert all(math.isclose(structure_energy(seq, s), e) and e <= got[best] + p.energy_window for s, e in got.items())
    # the partition function is the sum over all structures of a short sequence
    short = "GGGAAACCC"

    def every(i, j):
        if j - i < 4:
            return [()]
        out = list(every(i + 1, j))
        for k in range(i + 4, j + 1):
            if short[i] + short[k] in ("GC", "CG", "AU", "UA", "GU", "UG"):
                out += [((i, k), *x, *y) for x in every(i + 1, k - 1) for y in every(k + 1, j)]
        return out

    def text(ps):
        s = ["."] * len(short)
        for i, k in ps:
            s[i], s[k] = "(", ")"
        return "".join(s)

    everything = [text(x) for x in every(0, len(short) - 1)]
    assert len(set(everything)) == len(everything)
    z = math.log(sum(math.exp(-structure_energy(short, s) / RT) for s in everything))
    assert math.isclose(Fold(short, RT).outer[len(short)], z, rel_tol=1e-9)


def test_draws_made_together():
    """Counts of draws made together are those of the Boltzmann distribution."""
    seq, n = "GGGAAACCCAGGCAAAGCCA", 200_000
    fold = Fold(seq, RT)
    counts = fold.draws(n, np.random.RandomState(3))
    assert sum(counts.values()) == n and counts == fold.draws(n, np.random.RandomState(3))
    for s, k in counts.items():
        share = math.exp(-structure_energy(seq, s) / RT - fold.outer[len(seq)])
        assert abs(k - n * share) <= 6 * math.sqrt(n * share) + 6
    assert len(counts) > 50
    for most in (1, 7, 40):
        assert 1 <= len(list(sample_structures(seq, Params(max_structures=most), 1))) <= most


def test_degenerate_inputs(spark):
    n = nodes_of(spark, [0, 1, 2]).withColumn("batch", F.lit(0))
    e = edges_of(spark, [(0, 1)]).withColumn("batch", F.lit(0))
    m = analysis.graph_members(n, e, ["batch"])
    got = analysis.analyze_graph(n, e, m, P, ["batch"])
    assert got.count() == 0
    r = analysis.run_stats(got, n, m, P, ["batch"]).first()
    assert r.weighted_u_nt == 0 and r.f_inter == 0 and r.total_triplets == 0 and r.n_significant_components == 0 and r.n_components == 2


@pytest.mark.parametrize("model", ["full_analysis", "random_basins", "nt_shuffle"])
def test_whole_analysis(spark, model, tmp_path):
    seqs = spark.createDataFrame([(1, "first", "GGGAAACCCAGGGAAACCC"), (2, "second", "GGCGAAAGCCAAGGCAAAGCC")], "seq_id long, description string, seq string")
    p = Params(num_runs=2, max_structures=400, min_basin_size=1, alpha=0.001, null_model=model, num_null=2)
    out = analysis.analyze(seqs, p)
    summary = out["summary"].collect()
    assert {r.seq_id for r in summary} == {1, 2} and all(r.n_runs == 1 and r.n_structures > 2 for r in summary)  # the other run of each has no triplet
    assert {(r.seq_id, r.run_id) for r in out["failures"].collect()} == {(1, 1), (2, 0)}
    for r in summary:
        assert math.isclose(r.mean_u_nt + r.mean_u_tr + r.mean_u_non, 100, abs_tol=1e-6)
    names = [k for k in out if k.endswith("_summary")]
    assert len(names) == (2 if model == "full_analysis" else 1)
    null = out[names[0]]
    tables = reporting.report_tables(out, Params(**{**p.__dict__, "ensemble_row": True}))
    assert set(tables) == {"main"} | {v for k, v in reporting.MODELS.items() if f"null_{k}_summary" in out}
    main = [r.asDict() for r in tables["main"].collect()]
    assert sorted(x["description"] for x in main) == ["average", "first", "second"] and all("+/-" in x["n_basins"] and len(x["f_inter"].split("+/-")[0].split(".")[1]) == 4 for x in main)
    other = next(v for k, v in tables.items() if k != "main")
    assert other.columns == ["number", "description", "length", "real_u_nt", "null_u_nt", "null_u_tr", "null_u_non", "p_value"] and other.count() == 3
    row = reporting.ensemble(out["summary"], null).first()
    assert row.n == 2 and (row.null_p_value is None or 0 <= row.null_p_value <= 1)
    assert reporting.ensemble(out["summary"].limit(1)).first().std_u_nt == 0
    assert reporting.text_table(tables["main"]).count("\n") == 4
    reporting.write_table(tables["main"], str(tmp_path / "t"), "csv")
    assert spark.read.option("header", "true").csv(str(tmp_path / "t")).count() == 3
    assert "num_runs = 2" in reporting.parameter_lines(p)
    if model == "random_basins":  # one spectrum, other distances: samples differ, and none has more triplets than the real run
        samples = out["null_random_basins"].collect()
        assert {(r.seq_id, r.null_id) for r in samples} <= {(s, k) for s in (1, 2) for k in range(2)} and samples


def test_failed_runs_count_nowhere(spark):
    """A run without a triplet is in no mean, no spread and no p-value, and serves no null model."""
    columns = "seq_id long, run_id int, null_id int, weighted_u_nt double, weighted_u_tr double, weighted_u_non double, f_inter double, n_structures long, n_components long, n_significant_components int, n_processed_components int, total_basins int, total_triplets long"
    runs = spark.createDataFrame([(1, 0, -1, 0.0, 0.0, 0.0, 0.0, 7, 9, 9, 9, 0, 0), (1, 1, -1, 60.0, 30.0, 10.0, 0.5, 10, 4, 2, 1, 5, 10), (1, 2, -1, 40.0, 40.0, 20.0, 0.25, 13, 7, 3, 2, 8, 20), (2, 0, -1, 0.0, 0.0, 0.0, 0.0, 3, 1, 0, 0, 0, 0)], columns)
    seqs = spark.createDataFrame([(1, "one", "ACGU" * 20), (2, "two", "GGGG")], "seq_id long, description string, seq string")
    [r] = analysis.sequence_summary(seqs, runs).collect()
    assert (r.seq_id, r.n_runs, r.mean_u_nt, r.mean_f_inter, r.n_structures, r.std_n_structures, r.n_basins, r.std_n_basins, r.n_components, r.std_n_components) == (1, 2, 50.0, 0.375, 12, 2, 6, 2, 6, 2)
    assert (r.n_significant_components, r.n_processed_components, r.length, len(r.seq)) == (2.5, 1, 80, 50)
    samples = spark.createDataFrame([(1, k, x, 0.0, 0.0) for k, x in enumerate((0.0, 100.0, 49.0, 51.0))], "seq_id long, null_id int, u_nt double, u_tr double, u_non double")
    assert analysis.null_summary(runs, samples).first().p_value == 1.0
    assert [(r.seq_id, r.run_id) for r in analysis.successful(runs).orderBy("run_id").collect()] == [(1, 1), (1, 2)]


def test_program(spark, tmp_path):
    """From FASTA files, one with text ahead of its first record and one that holds none, to the report and the tables."""
    from foldscape import storage
    from foldscape.plans import program

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.fasta").write_text("a preface\nof two lines\n>first\nGGGAAACCCAGGGAAACCC\n>>odd\nACG\n")
    (tmp_path / "in/b.fasta").write_text(">second\nGGCGAAAGCCAAGG\nCAAAGCC")
    (tmp_path / "in/c.fasta").write_text("nothing here")
    made = len(storage._made)
    text = program.run(spark, str(tmp_path / "in"), program.parameters(["num_runs=2", "max_structures=400", "min_basin_size=1", "null_model=random_basins", "num_null=2", "ensemble_row=true"]), str(tmp_path / "out"))
    assert len(storage._made) == made
    for line in ("num_runs = 2", "summary: 2", "first", "second", "average", ">odd", "shorter than 10", "no record could be read", "control", "analysis:"):
        assert line in text, line
    assert "preface" not in text
    assert spark.read.parquet(str(tmp_path / "out/summary")).count() == 2
    assert "literal" in program.run(spark, "GGGAAACCCAGGGAAACCC", program.parameters(["num_runs=1", "max_structures=400", "min_basin_size=1", "null_model=none"]), literal=True)
    with pytest.raises(ValueError):
        program.parameters(["nothing=1"])


def test_sampling_failures_have_reasons(spark, monkeypatch):
    s = spark.createDataFrame([(1, "GGGAAACCC"), (2, ""), (3, None)], "seq_id long, seq string")
    got = sample(s, Params(num_runs=2, max_structures=5)).collect()
    assert {(r.seq_id, r.run_id) for r in got if r.reason} == {(k, run) for k in (2, 3) for run in (0, 1)}
    assert all((r.structure is None) == (r.reason is not None) for r in got)


def test_shared_folder_is_set_outside_local_mode(spark, monkeypatch):
    from foldscape import storage

    class Context:
        master = "spark://x:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        storage.shared_root(Session())


def test_stream(spark, tmp_path):
    from foldscape.streaming import sink_sequences, stream_fasta

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.fasta").write_text(">a\nACGUACGUACGU\n>b\nAC\n")
    for k in range(2):
        q = sink_sequences(stream_fasta(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"))
        q.awaitTermination(60)
        assert rows(spark.read.parquet(str(tmp_path / "out")), "description", "length") == [("a", 12), ("c", 10)][: k + 1]
        (tmp_path / "in/c.fasta").write_text(">c\nACGUACGUAC")


def test_statistics_and_text(spark, tmp_path):
    """The block of each sequence word by word, the average row beside the others', and text of fixed widths in files."""
    columns = "seq_id long, seq string, description string, length int, n_runs long, " + ", ".join(f"{k}_{c} double" for c in ("u_nt", "u_tr", "u_non", "f_inter") for k in ("mean", "std")) + ", " + ", ".join(f"{c} long, std_{c} long" for c in ("n_structures", "n_basins", "n_components"))
    summary = spark.createDataFrame([(7, "ACGU", "long one", 30, 2, 50.0, 1.5, 30.0, 0.25, 20.0, 0.0, 0.5, 0.125, 10, 1, 5, 0, 2, 0), (3, "GG", "short", 12, 1, 40.0, 0.0, 30.0, 0.0, 30.0, 0.0, 0.25, 0.0, 8, 0, 4, 0, 1, 0)], columns)
    null = spark.createDataFrame([(7, 4, 45.0, 2.0, 35.0, 1.0, 20.0, 0.5, 0.25)], "seq_id long, n long, mean_u_nt double, std_u_nt double, mean_u_tr double, std_u_tr double, mean_u_non double, std_u_non double, p_value double")
    got = [r.text for r in reporting.statistics(summary, {"energy": null}).orderBy("number").collect()]
    assert got[1] == "\n".join(
        ["long one, 30 letters, runs: 2", "  nontrivial: 50.00+/-1.50 %", "  trivial: 30.00+/-0.25 %", "  not ultrametric: 20.00+/-0.00 %", "  triplets between components: 0.5000+/-0.1250", "  structures: 10+/-1", "  basins: 5+/-0", "  components: 2+/-0",
         "  null model energy, samples: 4; nontrivial 45.00+/-2.00 %, trivial 35.00+/-1.00 %, not ultrametric 20.00+/-0.50 %; p = 0.2500"]
    )
    assert got[0].startswith("short, 12 letters, runs: 1\n") and got[0].endswith("\n  null model energy: no sample")
    table = reporting.main_table(summary, average=True)
    want = ["number  description  length  n_structures  n_basins  f_inter           u_nt          u_tr          u_non", "------  -----------  ------  ------------  --------  ----------------  ------------  ------------  ------------",
            "1       short        12      8+/-0         4+/-0     0.2500+/-0.0000   40.00+/-0.00  30.00+/-0.00  30.00+/-0.00", "2       long one     30      10+/-1        5+/-0     0.5000+/-0.1250   50.00+/-1.50  30.00+/-0.25  20.00+/-0.00",
            "        average      21      9+/-1         4+/-1     0.3750+/-0.1768   45.00+/-7.07  30.00+/-0.00  25.00+/-7.07"]
    squeezed = lambda lines: [" ".join(x.split()) for x in lines]
    text = reporting.text_table(table)
    assert squeezed(text.split("\n"))[2:] == squeezed(want)[2:] and text.split("\n")[0].startswith("number  description  length")
    assert len({x.rstrip().find("+/-") for x in text.split("\n")[2:]}) <= 2
    reporting.write_text(table, str(tmp_path / "t"))
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] and sorted(squeezed(r.value for r in spark.read.text(str(tmp_path / "t")).collect())) == sorted(squeezed(text.split("\n")))
    assert reporting.main_table(summary.where("false"), average=True).count() == 0


def test_stages_are_measured(spark):
    from foldscape.storage import kept, measured

    with measured() as noted:
        for n in (5, 7):
            assert kept(spark.range(n), "some").count() == n
        kept(spark.range(3).where("id > 9"), "none")
    kept(spark.range(4), "after")
    assert [(n, r) for n, r, _ in noted.found] == [("some", 5), ("some", 7), ("none", 0)]
    got = {r.stage: (r.tables, r.rows) for r in reporting.stage_table(spark, noted.found, 2).collect()}
    assert got == {"some": (2, 12), "none": (1, 0)}
