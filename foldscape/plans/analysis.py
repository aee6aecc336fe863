"""The whole analysis as plans over all sequences, runs and null samples at once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import half_even, sample_std, whole_std
from ..operators import nulls
from ..operators.basins import basin_weights, gradient_basins, top_basins
from ..operators.components import connected_components, significant_components
from ..operators.kinetics import basin_vectors, pairwise_distances, project_arrays, spectral_gap_filter, weighted_coordinates
from ..operators.modes import slow_modes
from ..operators.neighbors import edges_within, neighbor_graph
from ..operators.nulls import random_basins, with_samples
from ..operators.pairs import indexed_pairs
from ..operators.sampler import sample
from ..operators.stats import mean_std, two_sided_p
from ..operators.structures import KEYS, dedup_min_energy, distinct_capped, dotbracket_pairs, encode_pairs, energy_window, enough_states, node_index
from ..operators.triplets import between_share, score_points, shares, weighted_score
from ..params import Params
from ..storage import kept

SCORES = ("u_nt", "u_tr", "u_non")
#: Counts of a run, and their names in a summary.
COUNTED = {"n_structures": "n_structures", "total_basins": "n_basins", "n_components": "n_components"}


def states_of(structures: DataFrame, sequences: DataFrame, p: Params, keys: Sequence[str] = KEYS) -> DataFrame:
    """Nodes of the landscape from sampled structures: keys, node_id, pair_ids, pair_hash, structure, energy."""
    pair_keys = ["seq_id", "null_id"]
    has = "null_id" in sequences.columns
    seqs = sequences.select("seq_id", "seq", (F.col("null_id") if has else F.lit(-1)).cast("int").alias("null_id"))
    batch = seqs.withColumn("_key", F.struct(*pair_keys))
    pairs = indexed_pairs(batch, p.min_hairpin, "_key")
    parsed = energy_window(structures, p.energy_window, keys, p.tolerance).withColumns({"pairs": dotbracket_pairs(F.col("structure")), "_key": F.struct(*pair_keys)})
    coded = encode_pairs(parsed, pairs, [*keys, "_key"], "_key").drop("_key")
    return enough_states(node_index(dedup_min_energy(coded, keys), keys), keys)


def graph_members(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The components of each batch's graph, found once and kept: keys, node_id, component, comp_size."""
    return kept(connected_components(nodes, edges, keys), "members")


@dataclass
class Spectra:
    """What the distances of basins come from: keys, comp_id in all of them; with samples of random basins, null_id is theirs in basins and points."""

    #: comp_size, num_basins, basins (by rank)
    basins: DataFrame
    #: mode, eigenvalue, rank, num_noise, physical
    modes: DataFrame
    #: id (the basin's rank), vector
    points: DataFrame
    #: reason of components whose modes were not found
    failed: DataFrame


def component_spectra(nodes: DataFrame, edges: DataFrame, members: DataFrame, p: Params, keys: Sequence[str] = KEYS, samples: int | None = None, main_only: bool = False) -> Spectra:
    """Basins, slow modes and the basins' coordinates on them, of the significant components (or the main ones) with three basins or more.

    samples: so many deals of the nodes to basins of the same sizes at random, over the same modes, with null_id (one of keys) from 0.
    """
    on = [*keys, "comp_id"]
    chosen = significant_components(members, p.alpha, keys).select(*keys, "component", "comp_id")
    if main_only:
        chosen = chosen.where("comp_id = 0")
    local = kept(nodes.select(*keys, "node_id", "energy").join(members, [*keys, "node_id"]).join(chosen, [*keys, "component"]).select(*on, "node_id", "energy"), "local")
    inner = kept(edges_within(edges, local.select(*on, "node_id"), keys).select(*on, "src", "dst"), "inner")
    placed = kept(local.join(gradient_basins(local, inner, keys, p.tolerance), [*keys, "node_id"]), "placed")
    ranked = kept(top_basins(basin_weights(placed, p.rt, keys), p.min_basin_size, p.max_basins, keys, least=3).select(*on, "basin_id", "rank"), "ranked")
    groups = ranked.select(*on).distinct()
    usable = placed.join(groups, on, "left_semi")
    values, vectors, failed = slow_modes(usable, inner.join(groups, on, "left_semi"), p.num_modes, p.rt, p.prefactor, keys, order=["basin_id"])
    modes = spectral_gap_filter(values.select(*on, F.posexplode("eigenvalues").alias("mode", "eigenvalue")), p.gap_threshold, on)
    modes = kept(modes, "physical")
    dealt = usable.join(ranked, [*on, "basin_id"], "left").select(*on, "node_id", "energy", F.col("rank").cast("long").alias("basin_id"))
    sizes = usable.groupBy(*on).agg(F.count(F.lit(1)).alias("comp_size"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("rank", "basin_id"))), lambda x: x["basin_id"])  # of max_basins at most
    basins = ranked.groupBy(*on).agg(F.max("rank").cast("int").alias("num_basins"), names.alias("basins")).join(sizes, on)
    others = [k for k in keys if k != "null_id"]
    if samples is not None:
        energies = dealt.select(*on, "node_id", "energy")
        dealt = random_basins(dealt.drop("energy", "null_id"), samples, p.seed, others).join(energies.drop("null_id"), [*others, "comp_id", "node_id"])
        basins = with_samples(basins, samples)
    chi = basin_vectors(dealt.where("basin_id is not null"), p.rt, keys, least=usable.groupBy(*on).agg(F.min("energy").alias("_e0")).drop(*[k for k in ["null_id"] if samples is not None]))
    x = project_arrays(chi, vectors.drop(*(["null_id"] if samples is not None else [])), p.num_modes, keys, shared=samples is not None)
    physical = modes.where("physical")
    if samples is not None:
        physical = with_samples(physical, samples)
    points = weighted_coordinates(x, physical, p.rt, p.prefactor, keys)
    return Spectra(basins, modes, kept(points, "points"), failed)


def component_distances(found: Spectra, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, comp_id, a < b (basins by rank, from 0), d."""
    return pairwise_distances(found.points, keys).withColumns({"a": F.col("a") - 1, "b": F.col("b") - 1})


def analyze_graph(nodes: DataFrame, edges: DataFrame, members: DataFrame, p: Params, keys: Sequence[str] = KEYS, samples: int | None = None, main_only: bool = False) -> DataFrame:
    """One row for each component with enough basins: keys, comp_id, comp_size, num_basins, basins, eigenvalues, num_noise_modes, num_phys_modes,
    n_nontrivial, n_trivial, n_non, num_triplets, u_nt, u_tr, u_non, status and, where it failed, reason."""
    on = [*keys, "comp_id"]
    found = component_spectra(nodes, edges, members, p, keys, samples, main_only)
    counts = score_points(found.points, p, keys)
    spectrum = F.transform(F.array_sort(F.collect_list(F.struct("rank", "eigenvalue"))), lambda x: x["eigenvalue"])
    values = found.modes.groupBy(*on).agg(spectrum.alias("eigenvalues"), F.max("num_noise").cast("int").alias("num_noise_modes"), F.count_if("physical").cast("int").alias("num_phys_modes"))
    shared = on if samples is None else [c for c in on if c != "null_id"]
    drop = [] if samples is None else ["null_id"]
    rows = found.basins.join(values.drop(*drop), shared, "left").join(found.failed.drop(*drop), shared, "left").join(counts, on, "left")
    reason = F.coalesce("reason", F.when(F.coalesce("num_phys_modes", F.lit(0)) == 0, "no physical mode is left"))
    rows = rows.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "ok").otherwise("failed"))
    return shares(rows.fillna(0, ["n_nontrivial", "n_trivial", "n_non", "num_noise_modes", "num_phys_modes"]))


def run_stats(components: DataFrame, nodes: DataFrame, members: DataFrame, p: Params, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row for each batch: weighted scores, f_inter, counts (of all components too). Batches without a usable component have zeros."""
    ok = components.where("status = 'ok'")
    got = weighted_score(ok, keys).join(between_share(ok, keys), list(keys), "full") if keys else weighted_score(ok, keys).crossJoin(between_share(ok, keys))  # one row each
    processed = components.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("n_processed_components"))
    large = significant_components(members, p.alpha, keys).groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("n_significant_components"))
    every = members.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_components"))
    out = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_structures"), F.min("energy").alias("min_energy"))
    for x in (every, large, processed, got):
        out = out.join(x, list(keys), "left") if keys else out.crossJoin(x)  # one row each
    return out.withColumn("total_basins", F.col("total_basins").cast("int")).fillna(0)


def analyze_structures(structures: DataFrame, sequences: DataFrame, p: Params, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, members, components, runs) of sampled structures: the first of each distinct one, up to the cap of each batch."""
    first = distinct_capped(structures.where("structure is not null"), p.max_structures, keys)
    nodes = kept(states_of(first, sequences, p, keys), "nodes")
    edges = kept(neighbor_graph(nodes, keys), "edges")
    members = graph_members(nodes, edges, keys)
    components = kept(analyze_graph(nodes, edges, members, p, keys), "components")
    return nodes, edges, members, components, kept(run_stats(components, nodes, members, p, keys), "runs")


def successful(runs: DataFrame) -> DataFrame:
    """Runs of the sequences themselves with at least one triplet; the others have failed and count nowhere."""
    return nulls.usable_samples(runs.where("null_id = -1"))


def null_runs(model: str, nodes: DataFrame, edges: DataFrame, members: DataFrame, runs: DataFrame, sequences: DataFrame, p: Params) -> DataFrame:
    """Runs of a null model on the first successful run of each sequence: seq_id, null_id, u_nt, u_tr, u_non.

    The components of the real graph serve all samples but those with other edges; random basins share one spectrum too.
    """
    keys = list(KEYS)
    first = successful(runs).groupBy("seq_id").agg(F.min("run_id").alias("run_id"))
    n, e, m = (x.where("null_id = -1").join(first, ["seq_id", "run_id"]) for x in (nodes, edges, members))
    if model == "random_basins":
        e, m = e.select(*keys, "src", "dst"), kept(m, "main")
        components = kept(analyze_graph(n, e, m, p, keys, samples=p.num_null, main_only=True), "null_components")
        return _scores(weighted_score(components.where("status = 'ok'"), keys))
    if model == "energy_shuffle":
        n, e, m = nulls.energy_shuffle(n, p.num_null, p.seed), nulls.with_samples(e, p.num_null), kept(nulls.with_samples(m, p.num_null), "null_members")
    elif model == "topo_shuffle":
        n, e, m = nulls.energy_shuffle(n, p.num_null, p.seed + nulls.TOPOLOGY - nulls.ENERGY), nulls.topology_shuffle(e, p.num_null, p.swaps_per_edge, p.seed), None
    elif model == "nt_shuffle":
        shuffled = kept(nulls.letter_shuffle(sequences.join(first.select("seq_id"), "seq_id", "left_semi"), p.num_null, p.seed), "shuffled")
        one = type(p)(**{**p.__dict__, "num_runs": 1})
        return _scores(analyze_structures(kept(sample(shuffled, one), "samples"), shuffled, one)[-1])
    else:
        raise ValueError(f"not a null model: {model}")
    n, e = kept(n, "null_nodes"), kept(e.select(*keys, "src", "dst"), "null_edges")
    m = graph_members(n, e, keys) if m is None else m
    components = kept(analyze_graph(n, e, m, p, keys), "null_components")
    return _scores(run_stats(components, n, m, p, keys))


def _scores(runs: DataFrame) -> DataFrame:
    good = nulls.usable_samples(runs)
    return good.select("seq_id", "null_id", *[F.col(f"weighted_{c}").alias(c) for c in SCORES])


def null_summary(runs: DataFrame, samples: DataFrame) -> DataFrame:
    """seq_id, n, mean and std of each score over samples, and the p-value of the mean u_nt over the successful runs."""
    real = successful(runs).groupBy("seq_id").agg(F.avg("weighted_u_nt").alias("real_value"))
    p = two_sided_p(samples, real, ["seq_id"]).select("seq_id", "p_value")
    return mean_std(samples, SCORES, ["seq_id"]).join(p, "seq_id")


def sequence_summary(sequences: DataFrame, runs: DataFrame) -> DataFrame:
    """One row for each sequence with a successful run, over these runs: means and spreads of the scores and of f_inter; means and spreads of
    structures, basins and components as whole numbers; the mean of significant components; the first run's processed ones."""
    real = successful(runs)
    values = [*(f"weighted_{c}" for c in SCORES), "f_inter"]
    means = [c for v in values for c in (F.avg(v).alias(f"mean_{v.removeprefix('weighted_')}"), sample_std(F.col(v)).alias(f"std_{v.removeprefix('weighted_')}"))]
    counts = [c for v, name in COUNTED.items() for c in (half_even(F.avg(v)).alias(name), whole_std(F.col(v)).alias(f"std_{name}"))]
    others = [F.avg("n_significant_components").alias("n_significant_components"), F.min_by("n_processed_components", "run_id").alias("n_processed_components"), half_even(F.avg("total_triplets")).alias("total_triplets")]
    each = real.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n_runs"), *means, *counts, *others)
    return sequences.select("seq_id", F.substring("seq", 1, 50).alias("seq"), "description", F.length("seq").alias("length")).join(each, "seq_id")


def analyze(sequences: DataFrame, p: Params = Params(), structures: DataFrame | None = None) -> dict[str, DataFrame]:
    """All results: nodes, edges, members, components, runs, summary, failures, and null_<model> with its summary for the model(s) of the parameters.

    sequences: seq_id, description, seq; structures, if given: seq_id, run_id, null_id, ord, structure, energy.
    failures: seq_id, run_id, reason of what could not be sampled, and of runs without a triplet.
    """
    drawn = kept(sample(sequences, p), "samples") if structures is None else structures
    nodes, edges, members, components, runs = analyze_structures(drawn, sequences, p)
    none = runs.where("null_id = -1 and total_triplets = 0").select("seq_id", "run_id", F.lit("no component with three basins").alias("reason"))
    broken = drawn.where("reason is not null").select("seq_id", "run_id", "reason") if "reason" in drawn.columns else none.where("false")
    out = {"nodes": nodes, "edges": edges, "members": members, "components": components, "runs": runs, "summary": sequence_summary(sequences, runs), "failures": broken.unionByName(none)}
    models = {"none": (), "full_analysis": ("energy_shuffle", "topo_shuffle")}.get(p.null_model, (p.null_model,))
    for model in models:
        samples = kept(null_runs(model, nodes, edges, members, runs, sequences, p), "null_runs")
        out[f"null_{model}"] = samples
        out[f"null_{model}_summary"] = null_summary(runs, samples)
    return out


