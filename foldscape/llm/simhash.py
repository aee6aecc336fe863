"""SimHash fingerprints of documents, and the links between them.

The terms of a text are its runs of SHINGLE consecutive words (of fewer, all its words).
A term votes with the weight of its count on each of BITS signed bits, by two 64-bit
hashes; a fingerprint has a one where the votes' sum is positive, as hexadecimal.
Likeness is the share of equal bits.

`near_links` finds the pairs of distinct fingerprints within a Hamming radius.  A table holds
the fingerprints sorted by some of their bits, permuted to the front; those of one key are
compared in full.  Tables of min(radius, EXACT) + 1 blocks hold every pair within that radius
in at least one.  For a larger radius as many tables of chosen bits are added as find a pair
at the radius itself with probability 1 - MISS, a nearer one with more.  Each task sorts some
of the tables, in memory, and returns a forest of what it linked; the components of the forests
are the classes, and within a class all pairs are compared, so that a missed pair counts too
where other links lead from one to the other.  RADIUS is the radius at which documents count as near.

Defined results: null is the empty text, whose fingerprint is all zeros; equal texts have
equal fingerprints; of repeated ids, the order is that of a hash of the text; a null id
comes first; the only document is its own next; an empty table gives no rows.  A text
without words is near nothing; a very long one has votes of all its terms; copies are links; a class has the least id in it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import star_contraction
from .common import CHUNK_BYTES, id_text, kept, map_array, shared_folder, ship, write_bytes
from .words import mix, shingles, words

BITS = 128
SHINGLE = 5
#: Bits in which near documents differ at most: of the pairs of sf0.1 with a Jaccard of 0.8 or more, 57 of 58 are within it.
RADIUS = 26
EXACT = 6
MISS = 0.01
BLOCK = 2048
#: A smaller class is dealt into blocks of so many fingerprints too, into SPREAD blocks at most.
SMALL_BLOCK, SPREAD = 64, 16
#: Bytes of a range of documents, about.
RANGE_BYTES = 1 << 27
#: Rows of a table that are sorted at once.
TABLE_ROWS = 1 << 22
_SMALL = 64  # groups up to this size are compared together
_SECOND = np.uint64(0xD6E8FEB86659FD93)
_ROWS = 4096  # bit votes are made of so many terms at once


def fingerprints(texts: list[str]) -> np.ndarray:
    """One row of BITS / 8 bytes for each text."""
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    terms, first = shingles(words(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets), SHINGLE)
    out = np.zeros((len(texts), BITS // 8), dtype=np.uint8)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        both = np.stack([terms, mix(terms ^ _SECOND)], axis=1)
        begin = first[some]
        votes = np.zeros((len(some), BITS), dtype=np.int64)
        for a in range(0, len(terms), _ROWS):
            z = min(a + _ROWS, len(terms))
            i, j = np.searchsorted(begin, a, side="right") - 1, np.searchsorted(begin, z, side="left")
            cuts = np.maximum(begin[i:j] - a, 0)
            bits = np.unpackbits(both[a:z].view(np.uint8).reshape(z - a, BITS // 8), axis=1)
            votes[i:j] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * votes > np.diff(first)[some][:, None], axis=1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal bits of fingerprints, row by row."""
    return 1 - np.bitwise_count(a ^ b).sum(axis=1) / BITS


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars and fingerprint of each document, without a shuffle."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in _parts(b):
                hexes = [x.tobytes().hex() for x in fingerprints(texts)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t) for t in texts], type=pa.int64()), pa.array(hexes)], ["doc_id", "n_chars", "fingerprint"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    size = np.cumsum(pa.compute.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + CHUNK_BYTES, side="right")))
        part = batch.slice(i, j - i)
        yield part, part.column("text").to_pylist()
        i = j


def edited(text: str, following: str) -> str:
    """The text with its last floor(n/2) characters replaced by the first as many of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The fingerprint of each document and of its edited text, and its likeness to that and to the next document.

    Documents are parted by ranges of ids, by quantiles, and where one id (or none) fills several ranges, of hashes of
    their texts too; the first document of each range goes to the one before it too, so that each task sees the next
    document of its last. One shuffle of the texts, into as many ranges as there are shuffle partitions, or more if the
    input's files are larger than RANGE_BYTES each would take.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = id_text(docs, id_col, text_col).withColumns({"key": F.coalesce("doc_id", F.lit(-(1 << 63))), "tie": F.xxhash64("text")})
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), math.ceil(_file_bytes(docs) / RANGE_BYTES))
    found = rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)] if n > 1 else [0.5], 100_000).alias("q")).first()["q"]
    bounds, times = np.unique(np.array(found or [0], dtype=np.int64), return_counts=True)

    @F.pandas_udf("int")
    def bucket_of(key, tie):
        import pandas as pd

        return pd.Series(range_of(key.to_numpy(), tie.to_numpy(), bounds, times))

    first = rows.select("key", "tie", bucket_of("key", "tie").alias("bucket")).groupBy("bucket").agg(F.min(F.struct("key", "tie")).alias("head"))
    heads = sorted((r["bucket"], *r["head"]) for r in first.collect())  # a row for each range
    ahead = spark.createDataFrame([(k, t, heads[i - 1][0]) for i, (_, k, t) in enumerate(heads)] or [(0, 0, 0)], "head long, head_tie long, target int")
    own = F.struct(F.col("bucket"), F.lit(False).alias("ahead"))
    forward = F.struct(F.col("target").alias("bucket"), F.lit(True).alias("ahead"))
    dealt = (
        rows.withColumn("bucket", bucket_of("key", "tie"))
        .join(F.broadcast(ahead), (F.col("key") == F.col("head")) & (F.col("tie") == F.col("head_tie")), "left")  # a row for each range
        .withColumn("to", F.explode(F.when(F.col("head").isNotNull(), F.array(own, forward)).otherwise(F.array(own))))
        .select("to.bucket", "to.ahead", "key", "tie", "doc_id", "text")
        .repartitionById(n, F.col("bucket"))
        .sortWithinPartitions("bucket", "ahead", "key", "tie")
        .select("bucket", "ahead", "doc_id", "text")
    )
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last document, which waits for its next
        for b in batches:
            for part, texts in _parts(b):
                bucket, forward, ids = (part.column(c).to_pylist() for c in ("bucket", "ahead", "doc_id"))
                if held:
                    bucket, forward, ids, texts = [held[0], *bucket], [False, *forward], [held[1], *ids], [held[2], *texts]
                at = [i for i in range(len(ids) - 1) if not forward[i] and bucket[i] == bucket[i + 1]]
                held = None if forward[-1] else (bucket[-1], ids[-1], texts[-1])
                if not at:
                    continue
                own = fingerprints(texts)
                new = [edited(texts[i], texts[i + 1]) for i in at]
                other = fingerprints(new)
                mine = own[at]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[i] for i in at], type=pa.int64()),
                        pa.array([len(texts[i]) for i in at], type=pa.int64()),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in new]),
                        pa.array([x.tobytes().hex() for x in mine]),
                        pa.array([x.tobytes().hex() for x in other]),
                        pa.array(likeness(mine, other)),
                        pa.array(likeness(mine, own[[i + 1 for i in at]])),
                    ],
                    [x.split()[0] for x in schema.split(", ")],
                )

    return dealt.mapInArrow(run, schema)


def range_of(key: np.ndarray, tie: np.ndarray, bounds: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The range of each (key, tie): one ends ahead of each bound; a bound that stands several times ends ranges of its ties, of equal widths."""
    at = np.searchsorted(bounds, key, side="left")
    out = np.concatenate([[0], np.cumsum(times)])[at]
    same = np.flatnonzero(bounds[np.minimum(at, len(bounds) - 1)] == key)
    share = (tie[same].astype(np.float64) + 2.0**63) / 2.0**64
    out[same] += 1 + np.minimum((share * times[at[same]]).astype(np.int64), times[at[same]] - 1)
    return out.astype(np.int32)


def _file_bytes(df: DataFrame) -> int:
    """What Spark takes the input's size to be, 0 where it has no idea."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else 0


def tables(n: int, radius: int) -> np.ndarray:
    """Of each table, the bits of its key, as two words; n fingerprints are to be held."""
    edges = np.linspace(0, BITS, min(radius, EXACT) + 2).astype(int)
    chosen = [np.arange(a, z) for a, z in zip(edges[:-1], edges[1:], strict=True)]
    if radius > EXACT:
        rng = np.random.default_rng(20240502)
        k = min(max(12, n.bit_length() + 1), BITS - radius)
        found = math.prod((BITS - radius - i) / (BITS - i) for i in range(k))
        chosen += [rng.permutation(BITS)[:k] for _ in range(math.ceil(math.log(MISS) / math.log1p(-found)))]
    bits = np.zeros((len(chosen), BITS), dtype=np.uint8)
    for t, at in enumerate(chosen):
        bits[t, at] = 1
    return np.packbits(bits, axis=1).view(np.uint64)


def _words(names: list[str]) -> np.ndarray:
    """Fingerprints as rows of two words."""
    return np.frombuffer(bytes.fromhex("".join(names)), dtype=np.uint64).reshape(-1, 2)


def _node(p: np.ndarray) -> np.ndarray:
    return mix(p[:, 0] ^ mix(p[:, 1] + np.uint64(1))).view(np.int64)


def _within(p: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> np.ndarray:
    """Which of the pairs (i, j) are within the radius."""
    near = np.flatnonzero(np.bitwise_count(p[i, 0] ^ p[j, 0]) <= radius)
    return near[np.bitwise_count(p[i[near]] ^ p[j[near]]).sum(axis=1) <= radius]


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal keys."""
    cut = np.flatnonzero(key[1:] != key[:-1]) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])


def _small_pairs(starts: np.ndarray, ends: np.ndarray, p: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of places within the radius in the groups, by how far apart they stand."""
    sizes = ends - starts
    at = np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    last = np.repeat(ends, sizes)
    d = 1
    while True:
        ok = at + d < last
        at, last = at[ok], last[ok]
        if not len(at):
            return
        near = _within(p, at, at + d, radius)
        if len(near):
            yield at[near], at[near] + d
        d += 1


def _large_links(p: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """Links enough to connect what is linked in one group: each place that is reached looks at those not reached yet."""
    left = np.arange(len(p))
    todo: list[int] = []
    while len(left):
        if not todo:
            todo, left = [int(left[0])], left[1:]
        i = todo.pop()
        near = np.bitwise_count(p[left] ^ p[i]).sum(axis=1) <= radius
        if near.any():
            yield i, left[near]
            todo += left[near].tolist()
            left = left[~near]


def _unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the sets of i and j; root is the least place of each set, before and after."""
    while True:
        a, b = root[i], root[j]
        ok = a != b
        if not ok.any():
            return
        i, j, a, b = i[ok], j[ok], a[ok], b[ok]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def forest(p: np.ndarray, masks: np.ndarray, radius: int, rows: int = TABLE_ROWS) -> np.ndarray:
    """The least place that links found in these tables lead to, for each fingerprint."""
    root = np.arange(len(p))
    parts = 1 << max(0, math.ceil(math.log2(max(len(p), 1) / rows)))
    for m in masks:
        key = mix((p[:, 0] & m[0]) * np.uint64(0x9FB21C651E98DF25) ^ mix((p[:, 1] & m[1]) + np.uint64(1)))
        for part in range(parts):
            own = np.flatnonzero(key % np.uint64(parts) == part) if parts > 1 else np.arange(len(p))
            order = own[np.argsort(key[own])]
            if len(order) < 2:
                continue
            starts, ends = _groups(key[order])
            some = ends - starts > 1
            starts, ends = starts[some], ends[some]
            small = ends - starts <= _SMALL
            sets = np.concatenate([[0], np.cumsum((ends - starts)[small])])
            of = [order[a:z] for a, z in zip(starts[~small], ends[~small], strict=True)]
            sizes = np.diff(sets)
            at = order[np.repeat(starts[small], sizes) + np.arange(sets[-1]) - np.repeat(sets[:-1], sizes)]
            found = [(at[i], at[j]) for i, j in _small_pairs(sets[:-1], sets[1:], p[at], radius)]
            found += [(np.full(len(j), g[i]), g[j]) for g in of for i, j in _large_links(p[g], radius)]
            if found:
                _unite(root, *(np.concatenate(x) for x in zip(*found, strict=True)))
    return root


def _classes(prints: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """(fingerprint, n_docs, least, node) of each distinct fingerprint, and (node, component) of those with links."""
    spark = prints.sparkSession
    ship(spark)
    if not 0 <= radius < BITS:
        raise ValueError(f"radius must be between 0 and {BITS - 1}")
    least = F.min("doc_id") if "doc_id" in prints.columns else F.lit(None).cast("long")
    grouped = prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n_docs"), least.alias("least"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_node(_words(b.column("fingerprint").to_pylist())))], [*b.schema.names, "node"])

    distinct = kept(grouped.mapInArrow(number, "fingerprint string, n_docs long, least long, node long"), "prints")
    folder = shared_folder(spark, "words")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        p = [_words(b.column("fingerprint").to_pylist()) for b in batches]
        p = [x[x.any(axis=1)] for x in p]  # none without words
        n = sum(map(len, p))
        where = f"{folder}/{TaskContext.get().partitionId()}.bin"
        if n:
            write_bytes(where, [x.tobytes() for x in p])
            yield pa.RecordBatch.from_arrays([pa.array([where]), pa.array([n], type=pa.int64())], ["path", "n"])

    shards = sorted((r["path"], r["n"]) for r in distinct.select("fingerprint").mapInArrow(write, "path string, n long").collect())
    masks = tables(sum(n for _, n in shards), radius)
    tasks = min(len(masks), 2 * spark.sparkContext.defaultParallelism)
    paths = [x for x, _ in shards]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column("id").to_pylist():
                p = np.concatenate([np.zeros((0, 2), np.uint64), *(np.asarray(map_array(x, np.uint64)).reshape(-1, 2) for x in paths)])
                root = forest(p, masks[k::tasks], radius)
                at = np.flatnonzero(root != np.arange(len(p)))
                for i in range(0, len(at), 1 << 16):
                    x = at[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(_node(p[x])), pa.array(_node(p[root[x]]))], ["src", "dst"])

    edges = spark.range(0, tasks, 1, tasks).mapInArrow(link, "src long, dst long")
    return distinct, kept(star_contraction(edges), "classes")


def _met(distinct: DataFrame, groups: DataFrame, block: int) -> DataFrame:
    """The fingerprints of each class, dealt into blocks of which each two meet in one task."""
    members = distinct.join(groups.hint("merge"), "node")
    size = kept(groups.groupBy("component").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block, F.least(F.count(F.lit(1)) / SMALL_BLOCK, F.lit(SPREAD)))).cast("int").alias("n")), "sizes")  # read anew, as in add_links
    return (
        members.join(size.hint("merge"), "component")
        .withColumn("own", F.pmod(F.xxhash64("fingerprint"), F.col("n")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select("component", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "fingerprint", "n_docs")
        .repartition("component", "x", "y")
        .sortWithinPartitions("component", "x", "y", "own")
    )


def _compare(radius: int, emit):
    """Over rows sorted by (component, x, y): emit(names, weights, pairs) of some whole groups, pairs being runs of (i, j)."""

    def pairs(p, own, crossed, starts, ends) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        small = ends - starts <= _SMALL
        for i, j in _small_pairs(starts[small], ends[small], p, radius):
            ok = ~crossed[i] | (own[i] != own[j])
            yield i[ok], j[ok]
        for a, z in zip(starts[~small].tolist(), ends[~small].tolist(), strict=True):
            for i in range(a, z - 1):
                j = i + 1 + np.flatnonzero(np.bitwise_count(p[i + 1 : z] ^ p[i]).sum(axis=1) <= radius)
                if crossed[i]:
                    j = j[own[j] != own[i]]
                yield np.full(len(j), i), j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def solve(t: pa.Table, starts: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
            names = t.column("fingerprint").to_pylist()
            x, y, own, weight = (t.column(c).to_numpy() for c in ("x", "y", "own", "n_docs"))
            yield from emit(names, weight, pairs(_words(names), own, x != y, starts, ends))

        for b in batches:
            t = pa.Table.from_batches([b])
            if held is not None:
                t = pa.concat_tables([held, t]).combine_chunks()
            if not t.num_rows:
                continue
            keys = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("component", "x", "y")])
            cut = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            if len(cut):
                yield from solve(t.slice(0, int(cut[-1])), np.concatenate([[0], cut[:-1]]), cut)
            held = t.slice(int(cut[-1])) if len(cut) else t
        if held is not None:
            yield from solve(held, np.array([0]), np.array([held.num_rows]))

    return run


def near_pairs(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """fingerprint, other, distance: each pair of distinct fingerprints within the radius once, the lesser first."""

    def emit(names, weight, pairs):
        p = _words(names)
        for i, j in pairs:
            a, b = ([names[k] for k in x.tolist()] for x in (i, j))
            far = np.bitwise_count(p[i] ^ p[j]).sum(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(list(map(min, a, b)), type=pa.string()), pa.array(list(map(max, a, b)), type=pa.string()), pa.array(far)], ["fingerprint", "other", "distance"])

    return _met(*_classes(prints, radius), block).mapInArrow(_compare(radius, emit), "fingerprint string, other string, distance int")


def near_links(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """fingerprint, n_docs, n_links, n_near and class_id of each distinct fingerprint: how many other distinct ones are
    within the radius, how many other documents (copies too), and the least id that links lead to.

    prints has a column fingerprint (as `fingerprint` makes it), and doc_id if there is to be a class_id.
    A class of many fingerprints is parted into blocks and each two blocks meet in one task; no pair becomes a row.
    """
    distinct, groups = _classes(prints, radius)

    def emit(names, weight, pairs):
        links, docs = np.zeros(len(names), dtype=np.int64), np.zeros(len(names), dtype=np.int64)
        for i, j in pairs:
            np.add.at(links, i, 1)
            np.add.at(links, j, 1)
            np.add.at(docs, i, weight[j])
            np.add.at(docs, j, weight[i])
        at = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in at.tolist()], type=pa.string()), pa.array(links[at]), pa.array(docs[at])], ["fingerprint", "links", "docs"])

    counted = _met(distinct, groups, block).mapInArrow(_compare(radius, emit), "fingerprint string, links long, docs long")
    number = counted.groupBy("fingerprint").agg(F.sum("links").alias("links"), F.sum("docs").alias("docs"))
    of = distinct.join(groups.hint("merge"), "node").select("component", "fingerprint", "least")
    first = kept(of.groupBy("component").agg(F.min("least").alias("first")), "firsts")
    linked = of.join(first.hint("merge"), "component").join(number.hint("merge"), "fingerprint").select("fingerprint", "first", "links", "docs")
    return distinct.join(linked.hint("merge"), "fingerprint", "left").select(
        "fingerprint",
        "n_docs",
        F.coalesce("links", F.lit(0).cast("long")).alias("n_links"),
        (F.coalesce("docs", F.lit(0).cast("long")) + F.col("n_docs") - 1).alias("n_near"),
        F.when(F.col("first").isNull(), F.col("least")).otherwise(F.col("first")).alias("class_id"),
    )


def add_links(found: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Adds class_id and n_links (other documents within the radius, copies too) to rows with doc_id and fingerprint."""
    found = kept(found, "fingerprints")
    near = near_links(found.select("doc_id", "fingerprint"), radius).where(f"n_near > 0 and fingerprint != '{'0' * (BITS // 4)}'")
    links = kept(near, "links")  # read anew, so that a fingerprint of many copies can be split in the join
    both = found.join(links.select("fingerprint", F.col("class_id").alias("least"), "n_near").hint("merge"), "fingerprint", "left")
    return both.select(*found.columns, F.when(F.col("n_near").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("class_id"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_links"))
