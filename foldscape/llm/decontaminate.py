"""Benchmark decontamination: an FM-index for each shard of the training texts.

A window is WINDOW consecutive words of a benchmark item; an item of fewer words, but
not none, is one window.  A task cuts its texts into shards.  The index of a shard has
the benchmark's vocabulary as its alphabet: words outside it can be in no window, and
end a string, and strings shorter than the shortest window are left out.  All windows
whose words the shard has are searched backward at once, their occurrences located, and
the spans that they cover merged for each text.  Words are looked up by 64-bit hashes and
compared themselves, so that strangers of one hash are no hit.

The benchmark is read in blocks of about BLOCK_BYTES of text, each written to the
shared folder; the texts pass through one step for each block, which adds its spans.
What is found is the same however it is parted.

Defined results: a null or empty text has no words, is not hit and not contaminated;
items without words have no window; the windows of an item with a null id are searched
and hit like others, but there is no id to list; repeated items count once; repeated documents are
each judged; empty tables give no rows, or no hits.  A very long text is
searched whole.  Other columns pass through; an added column takes the place of one with its name.
"""

from __future__ import annotations

import hashlib
import itertools
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_from_text, chunks, filesystem, flat, shared_folder, write_bytes
from .fm_index import FMIndex, Patterns
from .words import Vocabulary, word_list, words

WINDOW = 13
#: Words in the index of a shard, and bytes of text read for it, about.
SHARD_WORDS = 1 << 19
SHARD_BYTES = 1 << 25
BLOCK_BYTES = 1 << 24
#: A document is contaminated where hit * CONTAMINATED >= words.
CONTAMINATED = 20
SCHEMA = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"


class Windows:
    """The windows of some benchmark items, as ids in their vocabulary."""

    def __init__(self, items: list[tuple[str | None, str]], size: int = WINDOW):
        found: dict[tuple[bytes, ...], set[str]] = {}
        for key, text in items:
            w = tuple(word_list(text))
            for i in range(max(1, len(w) - size + 1) if w else 0):
                keys = found.setdefault(w[i : i + size], set())
                if key is not None:
                    keys.add(key)
        self.vocabulary = Vocabulary(x for w in found for x in w)
        number = self.vocabulary.number
        self.patterns = Patterns([np.array([number[x] for x in w], dtype=np.int64) for w in found])
        self.items = [sorted(k) for k in found.values()]
        self.shortest = int(self.patterns.lengths.min(initial=1 << 30))


class Shard:
    """Texts whose index is still to be made."""

    def __init__(self, windows: Windows):
        self.windows = windows
        self.n_words: list[np.ndarray] = []
        self.symbols: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []
        self.at: list[np.ndarray] = []
        self.n_docs = self.size = self.bytes = 0

    def add(self, column: pa.Array) -> None:
        data, offsets = flat(column)
        for i, j in chunks(offsets):
            off = offsets[i : j + 1] - offsets[i]
            part = data[offsets[i] : offsets[j]]
            w = words(part, off)
            counts = np.diff(w.first)
            self.n_words.append(counts)
            ids = self.windows.vocabulary.ids(w, part)
            doc = np.repeat(np.arange(j - i), counts)
            known = np.flatnonzero(ids)
            if len(known):
                new = np.concatenate([[True], (np.diff(known) > 1) | (np.diff(doc[known]) > 0)])
                run = np.cumsum(new) - 1
                known = known[(np.bincount(run) >= self.windows.shortest)[run]]
            if len(known):
                new = np.concatenate([[True], (np.diff(known) > 1) | (np.diff(doc[known]) > 0)])
                place = np.arange(len(known)) + np.cumsum(new) - 1
                symbols = np.zeros(place[-1] + 2, dtype=np.int64)
                docs, at = symbols.copy(), symbols.copy()
                symbols[place], docs[place] = ids[known], doc[known] + self.n_docs
                at[place] = known - w.first[doc[known]]
                self.symbols.append(symbols), self.docs.append(docs), self.at.append(at)
                self.size += len(symbols)
            self.n_docs += j - i
        self.bytes += len(data)

    def result(self) -> tuple[np.ndarray, list[list[dict]], list[list[str]]]:
        """For each text: words, merged spans, items with an occurring window."""
        counts = np.concatenate(self.n_words) if self.n_words else np.zeros(0, np.int64)
        spans: list[list[dict]] = [[] for _ in range(self.n_docs)]
        items: list[set[str]] = [set() for _ in range(self.n_docs)]
        if self.size:
            text, doc, at = np.concatenate(self.symbols), np.concatenate(self.docs), np.concatenate(self.at)
            index = FMIndex(text)
            low, high = index.search(self.windows.patterns)
            hits = high - low
            window = np.repeat(np.arange(len(hits)), hits)
            if len(window):
                place = index.locate(np.repeat(low - np.cumsum(hits) + hits, hits) + np.arange(len(window)))
                edge = np.zeros(len(text) + 1, dtype=np.int64)
                np.add.at(edge, place, 1)
                np.add.at(edge, place + self.windows.patterns.lengths[window], -1)
                hit = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
                for a, z in zip(np.flatnonzero(hit[1:] & ~hit[:-1]).tolist(), np.flatnonzero(hit[:-1] & ~hit[1:]).tolist(), strict=True):
                    spans[doc[a]].append({"start": int(at[a]), "end": int(at[a]) + z - a})
                pairs = np.unique(doc[place] * len(hits) + window)
                for d, k in zip((pairs // len(hits)).tolist(), (pairs % len(hits)).tolist(), strict=True):
                    items[d].update(self.windows.items[k])
        return counts, spans, [sorted(x) for x in items]


_blocks: dict[str, Windows] = {}


def _windows(uri: str) -> Windows:
    if uri not in _blocks:
        _blocks.clear()
        where, path = filesystem(uri)
        with where.open_input_file(path) as f:
            _blocks[uri] = Windows(*pickle.loads(f.read()))
    return _blocks[uri]


def _search(uri: str):
    def work(columns: Iterator[pa.Array]) -> Iterator[list[pa.Array]]:
        windows = _windows(uri)
        shard, sizes = Shard(windows), []

        def done() -> Iterator[list[pa.Array]]:
            counts, spans, items = shard.result()
            a = 0
            for n in sizes:
                yield [pa.array(counts[a : a + n]), pa.array(spans[a : a + n], type=_SPANS), pa.array(items[a : a + n], type=pa.list_(pa.string()))]
                a += n

        for column in columns:
            shard.add(column)
            sizes.append(len(column))
            if shard.size >= SHARD_WORDS or shard.bytes >= SHARD_BYTES:
                yield from done()
                shard, sizes = Shard(windows), []
        yield from done()

    return work


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _blocks_of(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[str | None, str]]]:
    rows = benchmark.select(F.col(item_col).cast("string").alias("k"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    block, held = [], 0
    for r in rows.toLocalIterator():
        block.append((r.k, r.t))
        held += len(r.t.encode())
        if held >= BLOCK_BYTES:
            yield block
            block, held = [], 0
    if block:
        yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Adds n_words, spans (of hit words, merged), items, n_hit, n_items, items_sha256 and contaminated to each document."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "windows")
    old = {n: next(x for x in (n + "_" * i for i in range(1, len(docs.columns) + 2)) if x not in docs.columns) for n in ("spans", "items")}
    out, k = docs, 0
    for block in itertools.chain(_blocks_of(benchmark, item_col, item_text_col), [None]):
        if block is None and k:
            break
        uri = f"{folder}/{k:05d}.pickle"
        write_bytes(uri, [pickle.dumps((block or [], size))])
        if k:  # keep what the blocks before it have found
            out = out.withColumnsRenamed(old)
        out = add_from_text(out, _search(uri), SCHEMA, text_col)
        if k:
            out = out.withColumn("spans", _merged(F.concat("spans", old["spans"]))).withColumn("items", F.array_union("items", old["items"])).drop(*old.values())
        k += 1
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.withColumns({"n_hit": hit, "n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join(F.array_sort("items"), ","), 256)}).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * CONTAMINATED >= F.col("n_words"))
    )


def _merged(spans):
    """Overlapping or touching spans as one."""
    kind = "array<struct<start:bigint,end:bigint>>"

    def step(done, s):
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= s["start"]), joined).otherwise(F.concat(done, F.array(s))).cast(kind)

    return F.aggregate(F.array_sort(spans), F.array().cast(kind), step)


def items_digest(items: list[str]) -> str:
    """What items_sha256 holds for these items."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
