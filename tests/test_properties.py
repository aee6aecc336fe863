"""Operators against definitions written independently, on random inputs."""

import random

from pyspark.sql import functions as F

from foldscape.functions import set_key
from foldscape.operators import basins, components, neighbors


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_neighbours_are_single_moves(spark):
    rng = random.Random(5)
    made = []
    for batch in range(4):
        sets = {tuple(sorted(rng.sample(range(7), rng.randint(0, 4)))) for _ in range(40)}
        made += [(batch, k, list(s)) for k, s in enumerate(sorted(sets))]
    n = spark.createDataFrame(made, "batch int, node_id long, pair_ids array<int>").withColumn("pair_hash", set_key(F.col("pair_ids")))
    expected = sorted(
        (b, i, j) for b, i, x in made for c, j, y in made if b == c and i < j and (len(d := set(x) ^ set(y)) == 1 or len(d) == 2 and len(set(x) - set(y)) == 1)
    )
    assert rows(neighbors.neighbor_graph(n, ["batch"]), "batch", "src", "dst") == expected


def graph(rng, n, m):
    return sorted({(min(a, b), max(a, b)) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b})


def union(n, edges):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_components_and_basins(spark):
    rng = random.Random(9)
    for n, m in ((60, 45), (80, 160), (50, 0), (40, 39)):
        edges = graph(rng, n, m) if m != 39 else [(k, k + 1) for k in range(39)]
        energy = [rng.randint(0, 5) * 0.5 for _ in range(n)]
        nodes = spark.createDataFrame([(k, e) for k, e in enumerate(energy)], "node_id long, energy double")
        e = spark.createDataFrame(edges, "src long, dst long")
        assert rows(components.connected_components(nodes, e, []), "node_id", "component") == list(enumerate(union(n, edges)))
        near = {k: [b for a, b in edges if a == k] + [a for a, b in edges if b == k] for k in range(n)}
        pointer = {}
        for k in range(n):
            best = min(((energy[x], x) for x in near[k]), default=None)
            pointer[k] = best[1] if best and best[0] < energy[k] - 1e-9 else None
        flat = [(a, b) for a, b in edges if pointer[a] is None and pointer[b] is None and abs(energy[a] - energy[b]) < 1e-9]
        plateau = union(n, flat)

        def follow(k):
            while pointer[k] is not None:
                k = pointer[k]
            return plateau[k]

        assert rows(basins.gradient_basins(nodes, e, []), "node_id", "basin_id") == [(k, follow(k)) for k in range(n)]
