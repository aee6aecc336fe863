"""The divergence audit, whitening, and near-duplicate classes, each against a slow version and over odd inputs."""

import math
import random
import re
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldscape.llm import divergence, minhash_dedup, tokens, whitening
from foldscape.llm.queries import QUERIES

LOWER = {c: c + 32 for c in range(65, 91)}
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize(("kind", "pattern"), [(tokens.LETTERS, TERM), (tokens.SOLID, WORD)])
def test_runs(kind, pattern):
    rng = random.Random(1)
    texts = ["", "Abc", "", "é日 x", "x\x0by\x1cz"] + ["".join(rng.choice("aB é日9\t_@[`{\n") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    raw = [t.encode() for t in texts]
    letters, sizes, doc, first = tokens.runs(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]), kind)
    got = tokens.as_strings(letters, sizes).to_pylist()
    want = [pattern.findall(t.translate(LOWER)) for t in texts]
    assert got == [w for x in want for w in x]
    assert doc.tolist() == [k for k, x in enumerate(want) for _ in x]
    assert np.diff(first).tolist() == [len(x) for x in want]


def slow_audit(rows, least, top):
    """All terms of all sources, zero counts too, in whole numbers of Python."""
    rows = [tuple(x or "" for x in r[:3]) for r in rows]
    langs, out = {lang for lang, _, _ in rows}, []
    for lang in langs:
        docs = [(s, TERM.findall(t.translate(LOWER))) for x, s, t in rows if x == lang]
        within = {}
        for _, t in docs:
            for w in set(t):
                within[w] = within.get(w, 0) + 1
        kept = [w for w, n in within.items() if n >= least]

        def shares(texts, kept=kept):
            n = {w: sum(t.count(w) for t in texts) for w in kept}
            total = sum(n.values())
            return n, {w: 1 + 10**9 * (n[w] + 2) // (total + 2 * len(kept)) for w in kept}

        _, q = shares([t for _, t in docs])
        by = {s: shares([t for x, t in docs if x == s]) for s in {s for s, _ in docs}}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, (n, p) in by.items():
            parts = {
                "pair": [(x, sum(f(p[w], r[w]) for w in kept)) for x, (_, r) in by.items() if x != s],
                "term": [(w, f(p[w], q[w])) for w in kept if n[w] and p[w] > q[w]],
            }
            for part, items in parts.items():
                items = sorted(items, key=lambda i: (-i[1], i[0].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(items) if part == "pair" or k < top]
    return sorted(out)


@pytest.mark.parametrize(("tile", "block", "pairs", "held"), [(512, 1 << 18, 1 << 20, 1 << 20), (3, 20, 16, 50), (1, 7, 1, 1)])
def test_divergence(spark, monkeypatch, tile, block, pairs, held):
    for name, v in {"TILE": tile, "BLOCK_ROWS": block, "PAIRS": pairs, "HELD": held, "CHUNK": 400 if held < 100 else 4 << 20}.items():
        monkeypatch.setattr(divergence, name, v)
    rng = random.Random(2)
    words = ["the", "The", "of", "Ä", "ä", "日", "one2two", *("w" + chr(97 + k % 26) * (1 + k // 26) for k in range(60))]
    rows = [("en", f"s{min(rng.randint(0, 9), rng.randint(0, 9))}", " ".join(rng.choice(words[: rng.randint(3, 60)]) for _ in range(rng.randint(0, 40)))) for _ in range(150)]
    rows += [("de", f"s{k % 4}", "der die das") for k in range(20)] + [("en", "no terms", "..."), ("en", "no text", None), ("fr", "a", "une fois"), ("fr", "b", None), ("it", "alone", "uno uno")]
    rows += [(None, "x", "the of the"), (None, None, "the the"), ("", "y", "of The"), ("en", "s1", rows[0][2])] * 2 + [("en", "s2", "the of " * 3000)]
    docs = spark.createDataFrame([(*r, "own", 5) for r in rows], "lang string, source string, text string, term string, number int").repartition(5)
    got = sorted(tuple(r) for r in divergence.divergence(docs, least_docs=3, top=4).collect())
    assert got == slow_audit(rows, 3, 4)
    assert divergence.divergence(docs.where("false")).count() == 0


def test_shares_are_exact(spark):
    rows = [(3, 10**12, 10**6), (6 * 10**11, 16 * 10**12, 10**9), (0, 0, 0), (0, 0, 7), (10**12, 10**12, 1)]
    got = spark.createDataFrame(rows, "c long, n long, v long").select("c", "n", "v", divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (c + 2) // (n + 2 * v) if v else 1 for c, n, v in rows]


def test_divergence_of_the_tables(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("lang", "source", "text").collect()]
    assert sorted(tuple(r) for r in QUERIES["op11_divergence"](spark, sf).collect()) == slow_audit(rows, 10, 10)


def slow_whitening(vectors, k=4):
    """{place: x}, S, n, and numpy's components of all distinct vectors at once."""
    good = {i: tuple(math.floor(256 * c) for c in v) for i, v in enumerate(vectors) if v and all(c is not None and math.isfinite(c) for c in v)}
    size = max({len(x) for x in good.values()}, key=lambda d: (len({x for x in good.values() if len(x) == d}), d))
    good = {i: x for i, x in good.items() if len(x) == size}
    fit = np.array(sorted(set(good.values())))
    centred = fit - fit.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / len(fit))
    return good, fit.sum(axis=0).tolist(), len(fit), values[::-1][:k], axes[:, ::-1][:, :k], values.sum()


def test_whitening(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 7)
    rng = np.random.RandomState(3)
    base = rng.standard_normal((200, 6)) @ rng.standard_normal((6, 6)) * 3
    vectors = [[float(c) for c in v] for v in base] + [[float(c) for c in base[0]]] * 90
    vectors += [None, [], [None, 1.0, 1.0, 1.0, 1.0, 1.0], [math.nan] + [1.0] * 5, [math.inf] + [0.0] * 5, [-0.0] * 6, [0.001] * 6, [1.0] * 5, [3e7] + [0.0] * 5]
    table = spark.createDataFrame([(k, v, "own") for k, v in enumerate(vectors)], "vec_id long, embedding array<double>, whitened string").repartition(4)
    good, sums, n, values, axes, trace = slow_whitening(vectors)
    w = whitening.fit_whitening(table)
    assert (w.n, w.sums) == (n, sums) and w.identity_error < 1e-8
    assert np.allclose(w.variances, values, rtol=1e-9) and np.allclose(w.explained, values / trace, rtol=1e-9)
    got = {r.vec_id: r for r in whitening.whiten(table, w).collect()}
    assert set(got) == set(good)
    mean = np.array(sums) / n
    sign = np.sign((axes * w.projection).sum(axis=0))
    for k, x in good.items():
        assert np.allclose(got[k].whitened, (np.array(x) - mean) @ axes / np.sqrt(values) * sign, atol=1e-6)
        assert got[k].deviation == sum((n * v - s) ** 2 for v, s in zip(x, sums))


def test_whitening_of_nothing_and_of_one(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [math.nan])], [(1, [])]):
        t = spark.createDataFrame(rows, schema)
        w = whitening.fit_whitening(t)
        assert w.n == 0 and whitening.whiten(t, w).count() == 0
    t = spark.createDataFrame([(1, [0.5, 2.0]), (None, [0.5, 2.0])], schema)
    w = whitening.fit_whitening(t)
    assert (w.n, w.sums, w.variances, w.identity_error) == (1, [128, 512], [], 0.0)
    assert [(r.vec_id, r.whitened, r.deviation) for r in whitening.whiten(t, w).orderBy("vec_id").collect()] == [(None, [], 0), (1, [], 0)]
    t = spark.createDataFrame([(1, [3e38, -3e38]), (2, [0.0, 0.0])], schema)
    w = whitening.fit_whitening(t)
    assert w.sums == [2**63 - 1, -(2**63)] and len(w.variances) == 1 and whitening.whiten(t, w).count() == 2


def test_deviations_are_exact():
    rng = np.random.RandomState(5)
    for reach, n in ((200, 50_000), (2**27, 10**9), (2**40, 10**6), (200, 3 * 10**12)):
        x = rng.randint(-reach, reach, (20, 64))
        w = whitening.Whitening(n=n, sums=[int(v) * n // 3 for v in rng.randint(-reach, reach, 64)])
        want = [sum((n * v - s) ** 2 for v, s in zip(row, w.sums)) for row in x.tolist()]
        assert w.deviations(x) == [Decimal(v) if v < 10**38 else None for v in want]


def test_whitening_of_the_tables(spark, sf):
    vectors = [r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()]
    ids = [r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()]
    good, sums, n, values, axes, trace = slow_whitening(vectors)
    rows = QUERIES["op12_whitening"](spark, sf).collect()
    assert len(rows) == 4 * len(good) and {r.vec_id for r in rows} == {ids[k] for k in good}
    place = {i: k for k, i in enumerate(ids)}
    mean = np.array(sums) / n
    for r in rows:
        x, c = np.array(good[place[r.vec_id]]), r.component - 1
        assert abs(abs(r.whitened) - abs((x - mean) @ axes[:, c] / math.sqrt(values[c]))) < 1e-6
        assert (r.n, r.deviation) == (n, sum((n * int(v) - s) ** 2 for v, s in zip(x, sums)))
        assert abs(r.explained / (values[c] / trace) - 1) < 1e-9 and 0 <= r.identity_error < 1e-6


def slow_classes(texts, n=5, numerator=85, denominator=100):
    """(size, least place in its component) of each text, by comparing all pairs."""
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    label = list(range(len(texts)))
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a and b and denominator * len(a & b) >= numerator * len(a | b)]
    while True:
        new = list(label)
        for i, j in links:
            new[i] = new[j] = min(new[i], new[j])
        if new == label:
            return [(len(s), x) for s, x in zip(sets, label)]
        label = new


def varied(rng, n_base, copies, edits):
    texts = []
    for b in range(n_base):
        w = [rng.choice("abcdefghij") + str(rng.randint(0, 30)) for _ in range(rng.randint(20, 260))]
        for _ in range(rng.randint(1, copies)):
            x = list(w)
            for _ in range(rng.randint(0, edits)):
                x[rng.randrange(len(x))] = "New" + str(rng.randint(0, 9))
            texts.append(rng.choice([" ", "\n", "\t "]).join(x))
    return texts


@pytest.mark.parametrize(("block", "small"), [(512, 64), (4, 2)])
def test_duplicate_classes(spark, monkeypatch, block, small):
    monkeypatch.setattr(minhash_dedup, "SMALL_BLOCK", small)
    rng = random.Random(6)
    texts = varied(rng, 40, 7, 5) + varied(rng, 1, 60, 1) * 2
    texts += [None, "", " \n\t", "one two", "ONE\ttwo", "one two three", "é x y z w", "É x y z w", "a\x1cb c d e", "word " * 40_000, "word " * 39_000] + ["the same copy of a text with words"] * 30
    ids = rng.sample(range(-1000, 5000), len(texts))
    docs = spark.createDataFrame([(i, t, "own", 1, 2) for i, t in zip(ids, texts)], "doc_id long, text string, kept string, node int, tie int").repartition(6)
    got = {r.doc_id: r for r in minhash_dedup.duplicate_classes(docs, block=block).collect()}
    assert len(got) == len(texts)
    want = slow_classes(texts)
    least = {}
    for i, (_, label) in zip(ids, want):
        least[label] = min(i, least.get(label, i))
    for i, (size, label) in zip(ids, want):
        assert tuple(got[i]) == (i, size, least[label], i == least[label])
    assert sum(r.kept for r in got.values()) < len(texts) - 80


def test_duplicate_classes_of_odd_rows(spark):
    schema = "doc_id long, text string"
    assert minhash_dedup.duplicate_classes(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e f"), (None, None), (4, "A b c d e f"), (4, "A b c d e f"), (9, "a b  c d e f"), (4, ""), (None, "alone")]
    got = sorted((repr(tuple(r)) for r in minhash_dedup.duplicate_classes(spark.createDataFrame(rows, schema)).collect()))
    assert got == sorted(map(repr, [(None, 2, 4, False), (None, 0, None, True), (4, 2, 4, True), (4, 2, 4, True), (9, 2, 4, False), (4, 0, 4, True), (None, 1, None, True)]))


def test_signatures_keep_pairs_at_the_threshold():
    bands, rows = minhash_dedup.choose_bands(0.85, minhash_dedup.TARGET_RECALL, minhash_dedup.HASHES)
    assert 1 - (1 - 0.85**rows) ** bands >= minhash_dedup.TARGET_RECALL
    k = minhash_dedup.least_agreement(bands * rows, 0.85)
    rng = np.random.default_rng(7)
    assert (rng.binomial(bands * rows, 0.85, 1_000_000) < k).mean() < 1e-5
    assert (rng.binomial(bands * rows, 0.5, 100_000) >= k).mean() < 1e-3
    s = minhash_dedup.Signer(bands * rows, 5)
    a = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    b = np.concatenate([a[:1840], rng.integers(0, 1 << 63, 160, dtype=np.uint64)])
    x = s.signatures(np.concatenate([a, b]), np.array([0, 2000]))
    assert abs((x[0] == x[1]).mean() - 1840 / 2160) < 0.12
    assert minhash_dedup.likely((x[:1], x[1:]), (np.array([2000]), np.array([2000])), k, 85, 100).all()
    assert not minhash_dedup.likely((x[:1], x[1:]), (np.array([2000]), np.array([1699])), k, 85, 100).any()


def test_intersections(monkeypatch):
    monkeypatch.setattr(minhash_dedup, "COLUMNS", 5)
    rng = np.random.RandomState(8)
    sets = [np.unique(rng.randint(0, 40, rng.randint(1, 30))).astype(np.uint64) for _ in range(12)]
    left, right = np.arange(7), np.arange(7, 12)
    assert minhash_dedup.shared_counts(sets, left, right).tolist() == [[len(np.intersect1d(sets[i], sets[j])) for j in right] for i in left]
