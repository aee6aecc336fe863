"""Decontamination, fingerprints, the n-gram join and the pipeline."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foldscape.llm import decontaminate, fm_index, ngram_join, simhash, words
from foldscape.llm.queries import QUERIES

SCHEMA = "doc_id long, text string"
PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text):
    return PATTERN.findall((text or "").translate(LOWER))


def hits_of(text, items, size=13):
    """(words, hit places, items) by trying every window at every place."""
    windows = {}
    for key, t in items:
        w = words_of(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).update([] if key is None else [str(key)])
    w, hit, found = words_of(text), set(), set()
    for n in {len(x) for x in windows}:
        for k in range(len(w) - n + 1):
            if (x := tuple(w[k : k + n])) in windows:
                hit.update(range(k, k + n))
                found |= windows[x]
    return len(w), hit, found


def test_fm_index():
    rng = np.random.RandomState(2)
    for _ in range(40):
        text = np.append(rng.randint(0, 4, rng.randint(1, 60)), 0)
        order = fm_index.suffix_array(text)
        keys = [[(0, j) if text[j] == 0 else (1, int(text[j])) for j in range(i, i + text[i:].tolist().index(0) + 1)] for i in range(len(text))]
        assert order.tolist() == sorted(range(len(text)), key=lambda i: keys[i])
        index = fm_index.FMIndex(text, sample=4)
        patterns = [rng.randint(1, 5, rng.randint(1, 5)) for _ in range(30)]
        low, high = index.search(fm_index.Patterns(patterns))
        for p, a, z in zip(patterns, low, high, strict=True):
            places = [i for i in range(len(text) - len(p) + 1) if (text[i : i + len(p)] == p).all()]
            assert sorted(index.locate(np.arange(a, z)).tolist()) == places


@pytest.mark.parametrize(("shard", "block"), [(1 << 19, 1 << 24), (50, 40)])
def test_decontamination(spark, monkeypatch, shard, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rng = random.Random(3)
    v = "a b c d E é".split()
    items = [(k, " ".join(rng.choice(v) for _ in range(rng.randint(1, 9)))) for k in range(12)] + [(3, "a b"), (3, "a b"), (99, ""), (98, None), (97, "!!"), (None, "a B é é"), (None, "a b"), (None, None)]
    texts = [" ".join(rng.choice([*v, "zz", "A.", "B\n"]) for _ in range(rng.randint(0, 40))) for _ in range(120)] + [None, "", "...", "a b c", "a b c"]
    docs = spark.createDataFrame([(k, t, 5, "x") for k, t in enumerate(texts)], SCHEMA + ", n_words int, items string").withColumns({c: F.lit("own") for c in ("_spans", "_items", "spans_", "items_", "c0", "n0")}).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench, size=4).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        n, hit, found = hits_of(t, items, 4)
        r = got[k]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, len(hit), len(found), bool(hit) and 20 * len(hit) >= n)
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert {p for s in r.spans for p in range(s["start"], s["end"])} == hit
    none = decontaminate.decontaminate(docs, bench.where("false")).collect()
    assert len(none) == len(texts) and not any(r.n_hit or r.contaminated for r in none)
    assert decontaminate.decontaminate(docs.where("false"), bench).count() == 0


def thue_morse(n):
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("letters", [10, 12])
def test_words_that_are_not_the_same_are_no_hit(monkeypatch, letters):
    """Words that any polynomial hash modulo 2**64 takes for the same; and all words sharing one hash."""
    a, b = thue_morse(letters)
    assert words.hash_word(a.encode()) != words.hash_word(b.encode())
    for alike in (False, True):
        if alike:
            monkeypatch.setattr(words, "_hash", lambda letters, sizes: np.ones(len(sizes), np.uint64))
        shard = decontaminate.Shard(decontaminate.Windows([("a", a), ("c", "other words"), (None, "null id")]))
        shard.add(pa.array([a, b, f"{b} {a.upper()} x", "other Words null id", "words other"]))
        counts, spans, items = shard.result()
        assert counts.tolist() == [1, 1, 3, 4, 2] and items == [["a"], [], ["a"], ["c"], []]
        assert [[(s["start"], s["end"]) for s in x] for x in spans] == [[(0, 1)], [], [(1, 2)], [(0, 4)], []]


def test_decontamination_of_the_tables(spark, sf):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op7_decontamination"](spark, sf).collect():
        n, hit, found = hits_of(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, len(hit), len(found), bool(hit) and 20 * len(hit) >= n)


def test_edit_likeness(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice("abcdefghij") * 2 + rng.choice("klmn") for _ in range(rng.randint(0, 90)))) for k in rng.sample(range(-50, 5000), 150)] + [(7000, None), (7001, ""), (7002, "é日x"), (7003, "é日x")]
    docs = spark.createDataFrame([(*r, "f") for r in rows], SCHEMA + ", fingerprint string").repartition(6)
    got = {r.doc_id: r for r in simhash.edit_likeness(docs).collect()}
    rows.sort()
    assert len(got) == len(rows)
    for k, (key, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)]
        new = simhash.edited(t, after[1] or "")
        r = got[key]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        a, b = simhash.fingerprints([t, new])
        assert (r.fingerprint, r.edited_fingerprint) == (a.tobytes().hex(), b.tobytes().hex())
        assert r.near_next == simhash.likeness(a[None], np.frombuffer(bytes.fromhex(got[after[0]].fingerprint), np.uint8)[None])[0]
    assert got[7002].fingerprint == got[7003].fingerprint and got[7000].fingerprint == "0" * 32
    assert np.mean([r.near_edited - r.near_next for r in got.values() if r.n_chars > 60]) > 0.1
    one = spark.createDataFrame([(None, "only one here")], SCHEMA)
    assert [r.near_next for r in simhash.edit_likeness(one).collect()] == [1.0]
    assert simhash.edit_likeness(docs.where("false")).count() == 0
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "d e f")], SCHEMA)
    assert simhash.edit_likeness(twice).count() == 3
    assert simhash.fingerprint(docs).count() == len(rows)


def slow_simhash(text):
    """Votes of every term on every bit, one at a time, from the terms' two hashes of 64 bits."""
    w = words_of(text)
    terms = [w[k : k + 5] for k in range(max(1, len(w) - 4))] if w else []
    mask = (1 << 64) - 1

    def mix(h):
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h = (h ^ h >> 33) * factor & mask
        return h ^ h >> 33

    votes = [0] * 128
    for term in terms:
        h = 0
        for k in range(5):
            h = (h * 0x9FB21C651E98DF25 + 0x632BE59BD9B4E019) & mask
            h = mix(h ^ words.hash_word(term[k].encode()) if k < len(term) else h)
        both = h.to_bytes(8, "little") + mix(h ^ 0xD6E8FEB86659FD93).to_bytes(8, "little")
        for i, byte in enumerate(both):
            for j in range(8):
                votes[8 * i + j] += 1 if byte >> (7 - j) & 1 else -1
    return bytes(sum((votes[8 * i + j] > 0) << (7 - j) for j in range(8)) for i in range(16)).hex()


def test_fingerprints_are_the_slow_ones():
    rng = random.Random(8)
    texts = ["", "...", "one", "One two!", "a b c d e", "a b c d e f", "é 日本 x y z é"] + [" ".join(rng.choice("abcdef") + rng.choice("gh") for _ in range(rng.randint(1, 200))) for _ in range(60)]
    assert [p.tobytes().hex() for p in simhash.fingerprints(texts)] == [slow_simhash(t) for t in texts]


def test_ranges_split_one_id(spark):
    """One id (or none) on a third of the rows is dealt over several ranges, in the same order."""
    rng = np.random.RandomState(4)
    key = np.concatenate([np.full(4000, -(1 << 63)), rng.randint(0, 50, 2000), np.full(4000, 7)])
    tie = rng.randint(-(1 << 62), 1 << 62, len(key)) * 2
    bounds, times = np.unique(np.quantile(key.astype(float), np.arange(1, 20) / 20, method="nearest").astype(np.int64), return_counts=True)
    got = simhash.range_of(key, tie, bounds, times)
    order = np.lexsort((tie, key))
    assert (np.diff(got[order]) >= 0).all() and np.bincount(got).max() < 0.12 * len(key)
    docs = spark.createDataFrame([(None if k % 3 else k, f"text {k % 90} of many words") for k in range(300)], SCHEMA).repartition(4)
    found = simhash.edit_likeness(docs).collect()
    rows = sorted(((-1 if r.doc_id is None else r.doc_id), r.text) for r in docs.collect())
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in found) == [k for k, _ in rows]
    near = {r.doc_id: r for r in found if r.doc_id is not None}
    texts = dict(x for x in rows if x[0] >= 0)
    ids = sorted(texts)
    for a, b in zip(ids, ids[1:]):
        assert near[a].edited_sha256 == hashlib.sha256(simhash.edited(texts[a], texts[b]).encode()).hexdigest()


def test_near_links(spark):
    rng = np.random.RandomState(1)
    base = rng.randint(0, 256, (12, 16)).astype(np.uint8)
    prints = []
    for b in base:
        for _ in range(8):
            x = np.unpackbits(b)
            x[rng.choice(128, rng.randint(0, 6), replace=False)] ^= 1
            prints.append(np.packbits(x).tobytes().hex())
    d = spark.createDataFrame([(p,) for p in prints + prints[:5]], "fingerprint string")
    distinct = sorted(set(prints))
    near = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1") <= 6
    got = {r.fingerprint: r for r in simhash.near_links(d, 6, block=4).collect()}
    assert {k: r.n_links for k, r in got.items()} == {a: sum(near(a, b) for b in distinct if a != b) for a in distinct}
    assert sum(r.n_docs for r in got.values()) == len(prints) + 5


def test_near_copies_are_linked(spark):
    """Over whole documents: five-word terms, near copies at 0.8, classes, copies, and the pairs themselves."""
    rng = random.Random(4)
    texts = near_copies(rng, n_base=40, copies=5, edits=2) + ["only a few words stand here"] * 2 + [None, "", "..."]
    texts += [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 99)) for _ in range(60)) for _ in range(300)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], SCHEMA).repartition(5)
    found = simhash.edit_likeness(docs)
    got = {r.doc_id: r for r in simhash.add_links(found).collect()}
    assert len(got) == len(texts)
    prints = simhash.fingerprints([t or "" for t in texts])
    far = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2)
    near = (far <= simhash.RADIUS) & prints.any(axis=1)[:, None] & prints.any(axis=1)[None]
    np.fill_diagonal(near, False)
    label = list(range(len(texts)))
    for _ in texts:
        label = [min([label[k], *(label[j] for j in np.flatnonzero(near[k]))]) for k in range(len(texts))]
    assert [got[k].n_links for k in range(len(texts))] == near.sum(axis=1).tolist()
    assert [got[k].class_id for k in range(len(texts))] == label
    sets = [grams_of(t or "") for t in texts]
    alike = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(alike) > 50 and np.mean([near[i, j] for i, j in alike]) > 0.95
    pairs = [(r.fingerprint, r.other, r.distance) for r in simhash.near_pairs(found, block=3).collect()]
    hexes = [p.tobytes().hex() for p in prints]
    assert len(set(pairs)) == len(pairs)
    assert set(pairs) == {(hexes[i], hexes[j], far[i, j]) for i, j in zip(*np.nonzero(near), strict=True) if hexes[i] < hexes[j]}


def test_large_groups_of_fingerprints():
    """Large groups, and tables sorted in parts, link what comparing all pairs links."""
    rng = np.random.RandomState(2)
    bits = np.repeat(rng.randint(0, 2, (4, 128)), 150, axis=0).astype(np.uint8)
    bits ^= rng.random_sample(bits.shape) < 0.06
    p = np.packbits(bits, axis=1).view(np.uint64)
    near = np.bitwise_count(p[:, None] ^ p[None]).sum(axis=2) <= 16
    root = np.arange(len(p))
    for _ in range(20):
        root = np.where(near, root[None], len(p)).min(axis=1)
    masks = np.zeros((1, 2), dtype=np.uint64)  # one group of all
    assert np.array_equal(simhash.forest(p, masks, 16), root)
    assert np.array_equal(simhash.forest(p, simhash.tables(len(p), 16), 16), simhash.forest(p, simhash.tables(len(p), 16), 16, rows=100))


def grams_of(text, n=5):
    w = words_of(text)
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def brute_join(texts, threshold=0.8):
    """(links of each text, least place of its class) by comparing all pairs."""
    sets = [grams_of(t) for t in texts]
    n = len(sets)
    links, label = [0] * n, list(range(n))
    pairs = [(i, j) for i in range(n) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9]
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            low = min(label[i], label[j])
            if (label[i], label[j]) != (low, low):
                label[i] = label[j] = low
                changed = True
    return links, label


def near_copies(rng, n_base=25, copies=8, edits=4):
    texts = []
    for b in range(n_base):
        w = [rng.choice("abcdefghijklmnopqrst") + rng.choice("uvwxyz") + str(b % 7) for _ in range(rng.randint(30, 120))]
        for _ in range(rng.randint(1, copies)):
            x = list(w)
            for _ in range(rng.randint(0, edits)):
                x[rng.randrange(len(x))] = "new" + str(rng.randint(0, 9))
            texts.append(" ".join(x))
    return texts


@pytest.mark.parametrize(("block", "grams"), [(512, 1 << 20), (3, 1 << 20), (512, 200)])
def test_ngram_join(spark, monkeypatch, block, grams):
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", grams)
    rng = random.Random(block)
    texts = near_copies(rng) + ["one two", "One, two!", "one", "", None, "...", ""]
    texts += [texts[0]] * 3
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], SCHEMA + ", class_id int").repartition(4)
    got = {r.doc_id: r for r in ngram_join.jaccard_classes(docs, block=block).collect()}
    links, label = brute_join(texts)
    assert [got[k].n_links for k in range(len(texts))] == links
    assert [got[k].class_id for k in range(len(texts))] == label
    kept = ngram_join.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label))


def test_ngram_join_odd_rows(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (1, "other words stand here now"), (None, None), (None, None), (2, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id or 0, r.n_links, r.class_id or 0) for r in ngram_join.jaccard_classes(docs).collect())
    assert got == [(0, 0, 0), (0, 0, 0), (0, 2, 1), (1, 0, 1), (1, 2, 1), (1, 2, 1), (2, 0, 2)]
    assert ngram_join.drop_near_duplicates(docs).count() == 5
    assert ngram_join.jaccard_classes(docs.where("false")).count() == 0
    bands, rows_ = ngram_join.choose_bands(0.8)
    assert 1 - (1 - 0.8**rows_) ** bands >= ngram_join.TARGET_RECALL and bands * rows_ <= ngram_join.MOST_HASHES


def test_ngram_join_of_the_tables(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    links, label = brute_join([r.text for r in rows])
    got = {r.doc_id: r for r in QUERIES["op10_ngram_join"](spark, sf).collect()}
    assert [(got[r.doc_id].n_links, got[r.doc_id].class_id) for r in rows] == [(n, rows[k].doc_id) for n, k in zip(links, label, strict=True)]


def test_pipeline(spark, sf):
    """Each stage on what its predecessor kept, against brute force."""
    import corpus_pipeline as P

    from foldscape.llm.encode import encoder, tokenizer_path
    from foldscape.llm.secrets import base_spans, default_network, scan_column

    def masked(text, spans):
        """Every character of a finding gone, one mask where a finding or a chain of overlapping ones begins."""
        out = []
        for k, c in enumerate(text):
            if any(a == k for a, _ in spans) and not any(a < k < z for a, z in spans):
                out.append("[SECRET]")
            if not any(a <= k < z for a, z in spans):
                out.append(c)
        return "".join(out)

    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    toxic = dict(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic").collect())
    stage = {}
    now = docs
    for name, f in P.STAGES:
        now = f(spark, now, sf).cache()
        stage[name] = now.collect()
        if name != "packing":
            assert now.columns == docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    left = {r.doc_id for r in stage["toxicity"]}
    assert len(left) == len(stage["toxicity"]) and left < set(before)
    assert sum(not toxic.get(k, 0) for k in before if k not in left) <= 0.03 * len(before)
    ids = sorted(left)
    _, label = brute_join([before[k].text for k in ids])
    assert sorted(r.doc_id for r in stage["near_duplicates"]) == sorted({ids[k] for k in label})
    for_hits = {r.doc_id: hits_of(r.text, items) for r in stage["near_duplicates"]}
    assert {r.doc_id for r in stage["decontamination"]} == {k for k, (n, hit, _) in for_hits.items() if not (hit and 20 * len(hit) >= n)}
    assert [r.doc_id for r in stage["secrets"]] == [r.doc_id for r in stage["decontamination"]]
    for old, new in zip(stage["decontamination"], stage["secrets"], strict=True):
        assert new.n_chars == len(new.text) and new.text == masked(old.text, [(a, z) for a, _, z in scan_column(pa.array([old.text]), default_network())[0]])
        assert not base_spans(new.text)
    tok = encoder(tokenizer_path()).tok
    sizes = {r.doc_id: len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in stage["secrets"]}
    got: dict = {}
    for r in stage["packing"]:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == sizes
    assert P.run(spark, sf).agg(F.sum("length")).first()[0] == sum(sizes.values())


def test_toxicity_stage_rejects_toxic_documents(spark, sf):
    import corpus_pipeline as P

    big = sf.replace("sf0.001", "sf0.1")
    docs = spark.read.parquet(f"{big}/documents.parquet")
    left = {r.doc_id for r in P.toxicity(spark, docs, big).select("doc_id").collect()}
    toxic = dict(spark.read.parquet(f"{big}/labels.parquet").groupBy("doc_id").agg(F.max("toxic")).collect())
    assert np.mean([k not in left for k, t in toxic.items() if t]) > 0.85
    assert np.mean([k not in left for k, t in toxic.items() if not t]) < 0.01


def test_pipeline_on_odd_documents(spark, sf):
    """Nulls in every column, repeated rows, extra columns with names that operators use, and no rows at all."""
    import corpus_pipeline as P

    text = "these few words stand in two rows of the table"
    rows = [
        (1, text, "en", "s", 46), (1, text, "en", "s", 46), (2, text + " and more", None, None, None), (3, None, "en", "s", None), (4, "", "en", "s", 0),
        (None, "password = hunter2hunter2", "en", "s", 25), (None, None, None, None, None), (None, None, None, None, None), (5, "x" * 50_000, "en", "s", 50_000),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    clash = docs.withColumns({c: F.lit("own") for c in ("score", "predicted", "spans", "n_words", "items", "class_id", "tie", "key", "offset", "n_hit")})
    for start in (docs, clash, clash.where("false")):
        now = start
        for name, f in P.STAGES:
            now = f(spark, now, sf).cache()
            if name != "packing":
                assert now.columns == P.COLUMNS
                if name == "secrets":
                    kept = sorted((r.doc_id or 0, r.text or "") for r in now.collect())
        if start.isEmpty():
            assert now.count() == 0
        else:
            assert kept == [(0, ""), (0, ""), (0, "[SECRET]"), (1, text), (2, text + " and more"), (3, ""), (4, ""), (5, "x" * 50_000)]
            assert now.groupBy("doc_id").count().count() == 6
