"""Words, encoding, token files and packing."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foldscape.llm import encode, packing, token_files, words

SCHEMA = "doc_id long, text string"
ODD = ["", " ", "\n\n a", "Don't we'll", "x\x1c y", "é\xa0\xa0 b", "½ a½b ²", "œuvre – 日本 😀", "<|endoftext|> hi", "a\t b\r\n  c   ", "--- !! x", None]


@pytest.fixture(scope="module")
def tok():
    pytest.importorskip("public_tokenizers")
    return encode.tokenizer_path()


@pytest.fixture(scope="module")
def library(tok):
    """The library as it is, with none of this package's settings."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tok)


def true_ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [0]


def test_encoder_is_the_library(tok, library, monkeypatch):
    e = encode.Encoder(tok)
    rng = random.Random(4)
    alphabet = [chr(i) for i in range(256)] + list(" ") * 60 + list("\n\t") * 8 + list("ab1'") * 10 + ["日", "ſ", "\u2003", "\u200b", "\u3000", "<|endoftext|>", "'ll"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(6000)] + ODD[:-1]
    monkeypatch.setattr(encode, "CACHE_UNITS", 500)  # the table is emptied again and again
    monkeypatch.setattr(encode, "CHUNK_BYTES", 700)
    for i in range(0, len(texts), 50):
        part = texts[i : i + 50]
        for t, got in zip(part, e.encode(part), strict=True):
            assert library.encode(t, add_special_tokens=False).ids == got.tolist()
        ids, off = e.column(pa.array([None, *part]).slice(1), end=True)
        assert [ids[a:z].tolist() for a, z in zip(off[:-1], off[1:], strict=True)] == [true_ids(library, t) for t in part]
    monkeypatch.setattr(encode, "CACHE_CHARS", 1000)
    long = ["日本語" * 4000, "x" * 50_000, "a b " * 20_000, " \n" * 9000]
    for t in long * 2:
        assert library.encode(t, add_special_tokens=False).ids == e.encode([t])[0].tolist()


def test_words_are_the_pattern():
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = {c: c + 32 for c in range(65, 91)}
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB1é日 .\n_[`{\x7f\x80") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    w = words.words(np.frombuffer(b"".join(raw), np.uint8), offsets)
    for k, t in enumerate(texts):
        expected = [x.encode() for x in pattern.findall(t.translate(lower))]
        assert words.word_list(t) == expected
        assert [int(h) for h in w.hashes[w.first[k] : w.first[k + 1]]] == [words.hash_word(x) for x in expected]
    h, first = words.shingles(w, 3)
    for k in range(len(texts)):
        n = w.first[k + 1] - w.first[k]
        assert first[k + 1] - first[k] == (max(n - 2, 1) if n else 0)


def test_token_files(spark, tok, library):
    rng = random.Random(2)
    rows = [(k, rng.choice(ODD[:-1]) * rng.randint(1, 5)) for k in rng.sample(range(10_000), 300)] + [(5, None), (5, "b"), (5, "b"), (None, "none"), (-(1 << 63), "least")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    files = token_files.write_token_files(docs, tok)
    got = token_files.read_token_files(spark, files).collect()
    assert len(got) == len(rows)
    got.sort(key=lambda r: r.start)
    keys = [-(1 << 64) if r.doc_id is None else r.doc_id for r in got]
    assert keys == sorted(keys) and keys[1] == -(1 << 63)
    at = 0
    left = [(a, tuple(true_ids(library, t))) for a, t in rows]
    again = token_files.TokenFiles.open(files.folder)
    for r in got:
        ids = tuple(again.tokens(r.start, r.n_tokens).tolist())
        assert r.start == at and ids[-1] == 0 and zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32
        left.remove((r.doc_id, ids))
        at += r.n_tokens
    assert not left and files.dtype == "<u2"
    assert token_files.read_token_files(spark, token_files.write_token_files(docs.where("false"), tok)).count() == 0


def test_cuts_are_cheapest():
    rng = np.random.RandomState(0)
    for _ in range(60):
        window = int(rng.choice([8, 16]))
        pos = np.concatenate([[0], np.cumsum(rng.randint(1, 6, rng.randint(1, 30)))])
        pen = rng.randint(0, 5, len(pos)).astype(float)

        def cost(cuts):
            total = 0.0
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                n = int(pos[j] - pos[i])
                total += (0 if n & (n - 1) == 0 else window - n) + pen[j] + 1.5
            return total

        best = [0.0] + [np.inf] * (len(pos) - 1)
        for j in range(1, len(pos)):
            for i in range(j):
                n = int(pos[j] - pos[i])
                if n <= window:
                    best[j] = min(best[j], best[i] + (0 if n & (n - 1) == 0 else window - n) + pen[j] + 1.5)
        cuts = packing.choose_cuts(pos, pen, window, 1.5)
        assert cuts[0] == 0 and cuts[-1] == len(pos) - 1 and np.isclose(cost(cuts), best[-1])


@pytest.mark.parametrize(("window", "run"), [(64, 1 << 17), (1024, 1 << 17), (64, 300)])
def test_pack(spark, tok, library, window, run, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(packing, "RUN_TOKENS", run)
    rows = [(k, " ".join(rng.choice(["one two.", "three", "four!\n", "fünf"]) for _ in range(rng.choice([0, 3, 40, 900])))) for k in range(60)] + [(7, None), (7, "x"), (7, "x"), (None, "y"), (99, "nosentence" * 2000)]
    docs = spark.createDataFrame([(*r, "a", 1) for r in rows], SCHEMA + ", sequence_id string, `offset` int").repartition(3)
    got = packing.pack(docs, tok, window).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    for pieces in by.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window
    left = {}
    for key, t in rows:
        ids = true_ids(library, t)
        left.setdefault(key, []).extend(zlib.crc32(np.array([len(ids)], "<u4").tobytes()) for _ in ids)
    for r in got:
        for _ in range(r.length):
            left[r.doc_id].remove(zlib.crc32(np.array([r.doc_tokens], "<u4").tobytes()))
    assert not any(left.values())
    whole = {k: true_ids(library, t) for k, t in rows if k not in (7, None)}
    for r in got:
        if r.doc_id in whole:
            assert zlib.crc32(np.array(whole[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    sizes = [sum(r.length for r in p) for p in by.values()]
    padding = sum(window - n for n in sizes if n & (n - 1))
    assert padding < 0.15 * sum(sizes)
    assert packing.pack(docs.where("false"), tok).count() == 0


def test_runs_do_not_close_windows(spark, tok, monkeypatch):
    """However short the runs, only the end of a partition may leave a window far from full."""
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(["one two.", "three", "four!"]) for _ in range(rng.randint(1, 60)))) for k in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    cost = {}  # what the cuts are chosen by, but for their penalties
    for run in (1 << 17, 300):
        monkeypatch.setattr(packing, "RUN_TOKENS", run)
        sizes = [r.n for r in packing.pack(docs, tok, 64).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()]
        cost[run] = sum(64 - n for n in sizes if n & (n - 1)) + packing.SEQUENCE_COST * len(sizes)
    assert cost[300] <= 1.02 * cost[1 << 17], cost  # runs of 16 windows; 3 % and more if each closed one
