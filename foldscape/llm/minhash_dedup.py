"""MinHash near-duplicate classes: components of the documents whose sets of word shingles are alike enough.

1. Signatures: HASHES minima of universal hashes (a x + b) mod 2^64, their upper halves, over each document's shingles.
   Documents with the same set are one node from the start, so that copies, however many, are one node.
2. Banding: of the signature, chosen so that a pair at the threshold shares a band with the wanted probability. The nodes of one
   band's key are a bucket; of buckets with the same nodes one stays. A bucket is dealt into blocks, and each two blocks meet in one task.
3. Signature verification there, of signatures alone: a pair goes on in the first bucket that both are in, if its sizes allow the
   threshold and its signatures agree in as many places as all but MISSED of the pairs at the threshold do. What a task returns
   are the nodes that have such a partner in it, never pairs.
4. Full sets: these nodes' texts are read, cut into shingles and sent to the blocks where they have a partner; intersections of all
   pairs in a block are a matrix product over the shingles that more than one of them has. A task returns a forest of the links.
5. Components of the forests by alternating large-star and small-star.

Words are runs of anything but white space (space, tab to carriage return), A-Z lower-cased.

Defined results: a text of one to n-1 words has one shingle of all its words; one without words, or a null one, has none, is linked
to nothing and is its own component; a very long text is worked on whole; repeated rows are copies of one another. Where ids are null,
the component is the least id in it that isn't, if there is one. An empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import star_contraction
from .common import chunks, flat, id_text, kept, ship
from .ngram_join import choose_bands
from .tokens import SOLID, runs
from .words import Words, _hash, mix, shingles

N = 5
#: Links: DENOMINATOR x intersection >= NUMERATOR x union.
NUMERATOR, DENOMINATOR = 85, 100
HASHES = 128
#: Probabilities: that a pair at the threshold shares a band, and that signatures turn it away.
TARGET_RECALL, MISSED = 0.9999, 1e-7
#: Nodes of a block; smaller buckets are dealt too, into SPREAD blocks of SMALL_BLOCK nodes at most; shingles of a block, about.
BLOCK, SMALL_BLOCK, SPREAD, BLOCK_GRAMS = 512, 64, 8, 1 << 20
#: Shingles that are multiplied at once.
COLUMNS = 4096


def least_agreement(hashes: int, threshold: float, missed: float = MISSED) -> int:
    """The most places in which signatures must agree so that a pair at the threshold falls short with at most this probability."""
    total = 0.0
    for k in range(hashes + 1):
        total += math.comb(hashes, k) * threshold**k * (1 - threshold) ** (hashes - k)
        if total > missed:
            return k
    return hashes


class Signer:
    def __init__(self, hashes: int, n: int):
        rng = np.random.default_rng(20240615)
        self.n, self.hashes = n, hashes
        self.a = rng.integers(0, 1 << 63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, hashes, dtype=np.uint64) * np.uint64(2)

    def sets(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the distinct shingles' hashes of each text, ascending, and the first of each text)."""
        letters, sizes, _, first = runs(data, offsets, SOLID)
        none = np.zeros(0, dtype=np.int64)
        h, first = shingles(Words(none, none, _hash(letters, sizes), first), self.n)
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        return h[new], np.searchsorted(doc[new], np.arange(len(first)))

    def signatures(self, h: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """One row of minima for each set of hashes, none empty."""
        out = np.empty((len(begin), self.hashes), dtype="<u4")
        for k in range(self.hashes):
            out[:, k] = np.minimum.reduceat(h * self.a[k] + self.b[k], begin) >> np.uint64(32)
        return out


def _signed(docs: DataFrame, s: Signer) -> DataFrame:
    """doc_id, tie, k1, k2 (128 bits of the set; null where it's empty), size, signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for i, j in chunks(offsets):
                h, first = s.sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                size = np.diff(first)
                some = np.flatnonzero(size)
                begin = first[some]
                keys = np.zeros((2, j - i), dtype=np.uint64)
                signature = np.array([None] * (j - i), dtype=object)
                if len(some):
                    for k, salt in enumerate((0, 0xA0761D6478BD642F)):
                        keys[k, some] = np.add.reduceat(mix(h ^ np.uint64(salt)), begin)
                    signature[some] = [row.tobytes() for row in s.signatures(h, begin)]
                part = batch.slice(i, j - i)
                ids = [pa.array(k.view(np.int64), mask=size == 0) for k in keys]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tie"), *ids, pa.array(size.astype(np.int64)), pa.array(signature, pa.binary())], ["doc_id", "tie", "k1", "k2", "size", "signature"])

    return docs.mapInArrow(run, "doc_id long, tie long, k1 long, k2 long, size long, signature binary")


def _by_block(work, columns: list[str], out: dict[str, pa.DataType]):
    """For mapInArrow over rows sorted by (bucket, x, y): work gets the rows of each, as a dict of lists, and gives lists of results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {c: [] for c in columns}
        found: dict[str, list] = {c: [] for c in out}

        def close() -> None:
            for c, v in work(*key, held).items():
                found[c] += v
            for v in held.values():
                v.clear()

        def done() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(found[c], type=t) for c, t in out.items()], list(out))
            for v in found.values():
                v.clear()
            return b

        for batch in batches:
            bucket, x, y = (batch.column(c).to_numpy() for c in ("bucket", "x", "y"))
            cuts = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0)) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if a == z:
                    continue
                now = (int(bucket[a]), int(x[a]), int(y[a]))
                if key is not None and now != key:
                    close()
                    if len(next(iter(found.values()))) > 10_000:
                        yield done()
                key = now
                for c in columns:
                    held[c] += batch.column(c).slice(a, z - a).to_pylist()
        if key is not None:
            close()
        yield done()

    return run


def likely(signatures: tuple[np.ndarray, np.ndarray], sizes: tuple[np.ndarray, np.ndarray], least: int, numerator: int, denominator: int) -> np.ndarray:
    """Which pairs of a left and a right set may be at the threshold, by their sizes and signatures."""
    agree = np.zeros((len(sizes[0]), len(sizes[1])), dtype=np.int16)
    for a, b in zip(signatures[0].T, signatures[1].T, strict=True):
        agree += a[:, None] == b[None, :]
    a, b = sizes[0][:, None], sizes[1][None, :]
    return (agree >= least) & (denominator * np.minimum(a, b) >= numerator * np.maximum(a, b))


def seen_before(bucket: int, lists: list[list[int]], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs are both in a bucket of a lesser number, and so looked at there."""
    out = np.zeros((len(left), len(right)), dtype=bool)
    of = np.array([b for x in lists for b in x], dtype=np.int64)
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    row, of = row[of < bucket], of[of < bucket]
    order = np.argsort(of, kind="stable")
    row, of = row[order], of[order]
    place = np.full((2, len(lists)), -1)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    for members in np.split(row, np.flatnonzero(np.diff(of)) + 1):
        i, j = place[0, members], place[1, members]
        out[np.ix_(i[i >= 0], j[j >= 0])] = True
    return out


def shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of each left and right set."""
    doc = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, gram, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    doc = doc[count[gram] > 1]
    _, gram = np.unique(gram[count[gram] > 1], return_inverse=True)
    order = np.argsort(gram, kind="stable")
    gram, doc = gram[order], doc[order]
    place = np.full((2, len(sets)), -1)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    top = int(gram[-1]) + 1 if len(gram) else 0
    for a in range(0, top, COLUMNS):
        i, j = np.searchsorted(gram, [a, a + COLUMNS])
        sides = []
        for side, n in ((0, len(left)), (1, len(right))):
            m = np.zeros((n, min(COLUMNS, top - a)), dtype=np.float32)
            at = place[side, doc[i:j]]
            m[at[at >= 0], gram[i:j][at >= 0] - a] = 1
            sides.append(m)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    return out


def least_reached(found: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The least place that each of n places can reach over links of left and right ones."""
    root = np.arange(n)
    while True:
        new = root.copy()
        new[left] = np.minimum(new[left], np.where(found, root[right][None, :], n).min(axis=1, initial=n))
        new[right] = np.minimum(new[right], np.where(found, new[left][:, None], n).min(axis=0, initial=n))
        if (new == root).all():
            return root
        root = new


def _met(rows: DataFrame, *carried: str) -> DataFrame:
    """Rows dealt so that each block of two meets in one task, in order."""
    return rows.select("bucket", "x", "y", "own", "node", *carried).repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "node")


def duplicate_classes(docs: DataFrame, numerator: int = NUMERATOR, denominator: int = DENOMINATOR, n: int = N, recall: float = TARGET_RECALL, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles (size of its set), component_id (the least id that links lead to, its own included), kept (whether that's its own)."""
    spark = docs.sparkSession
    ship(spark)
    threshold = numerator / denominator
    bands, rows = choose_bands(threshold, recall, HASHES)
    least = least_agreement(bands * rows, threshold)
    s = Signer(bands * rows, n)
    texts = id_text(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    signed = kept(_signed(texts, s), "signed")
    # one node for each set, numbered as it is written
    nodes = kept(
        signed.where("k1 is not null")
        .groupBy("k1", "k2")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie")).alias("least"), F.first("size").alias("size"), F.first("signature").alias("signature"))
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )

    def key(b: int) -> Column:
        return F.xxhash64(F.lit(b), F.substring("signature", 4 * rows * b + 1, 4 * rows))

    keyed = kept(nodes.select("node", "size", F.posexplode(F.array(*map(key, range(bands)))).alias("band", "key")), "keyed")
    members = [F.bit_xor(F.xxhash64("node")).alias("m1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("m2")]
    full = keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("grams"), *members).where("n > 1")
    blocks = F.ceil(F.greatest(F.col("n") / block, F.least(F.col("n") / SMALL_BLOCK, F.lit(SPREAD)), F.col("grams") / BLOCK_GRAMS)).cast("int")
    buckets = kept(full.groupBy("n", "grams", "m1", "m2").agg(F.min(F.struct("band", "key")).alias("first")).select("first.*", blocks.alias("blocks"), F.monotonically_increasing_id().alias("bucket")), "buckets")
    inside = keyed.join(buckets, ["band", "key"]).groupBy("node").agg(F.collect_list(F.struct("bucket", "blocks")).alias("inside"))  # one for each band at most
    dealt = (
        nodes.join(inside, "node")
        .withColumns({"of": F.explode("inside"), "buckets": F.col("inside.bucket")})
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("of.blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of.blocks") - 1)))
        .withColumns({"bucket": F.col("of.bucket"), "x": F.least("own", "other"), "y": F.greatest("own", "other")})
    )

    def check(bucket: int, x: int, y: int, t: dict[str, list]) -> dict[str, list]:
        own, size = np.array(t["own"]), np.array(t["size"], dtype=np.int64)
        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        signature = np.frombuffer(b"".join(t["signature"]), dtype="<u4").reshape(len(own), -1)
        found = likely((signature[left], signature[right]), (size[left], size[right]), least, numerator, denominator)
        if x == y:
            np.fill_diagonal(found, False)
        if found.any():
            found &= ~seen_before(bucket, t["buckets"], left, right)
        at = np.union1d(left[found.any(axis=1)], right[found.any(axis=0)]).tolist()
        return {"node": [t["node"][k] for k in at], "bucket": [bucket] * len(at), "x": [x] * len(at), "y": [y] * len(at), "own": own[at].tolist()}

    kinds = {"node": pa.int64(), "bucket": pa.int64(), "x": pa.int32(), "y": pa.int32(), "own": pa.int32()}
    checked = kept(_met(dealt, "size", "signature", "buckets").mapInArrow(_by_block(check, ["own", "node", "size", "signature", "buckets"], kinds), "node long, bucket long, x int, y int, own int"), "checked")
    places = checked.groupBy("node").agg(F.collect_list(F.struct("bucket", "x", "y", "own")).alias("places"))  # bounded by bands and blocks
    wanted = nodes.select("node", "least.doc_id", "least.tie").join(places, "node")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for i, j in chunks(offsets):
                h, first = s.sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                grams = [h[a:z].astype("<u8").tobytes() for a, z in zip(first[:-1], first[1:], strict=True)]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("places"), pa.array(grams, type=pa.binary())], ["node", "places", "grams"])

    place = "struct<bucket:long,x:int,y:int,own:int>"
    of_nodes = texts.alias("t").join(wanted.hint("merge").alias("w"), F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("t.tie") == F.col("w.tie"))).select("node", "places", "text")
    # a repeated row, or another text with the same id and hash, is in the block twice at worst, which changes no link
    sets = of_nodes.mapInArrow(cut, f"node long, places array<{place}>, grams binary").select("node", F.explode("places").alias("p"), "grams").select("node", "p.*", "grams")

    def confirm(bucket: int, x: int, y: int, t: dict[str, list]) -> dict[str, list]:
        own = np.array(t["own"])
        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        grams = [np.frombuffer(g, dtype="<u8") for g in t["grams"]]
        size = np.array([len(g) for g in grams], dtype=np.int64)
        shared = shared_counts(grams, left, right)
        linked = denominator * shared >= numerator * (size[left][:, None] + size[right][None, :] - shared)
        root = least_reached(linked, left, right, len(own))
        at = np.flatnonzero(root != np.arange(len(own))).tolist()
        return {"src": [t["node"][k] for k in at], "dst": [t["node"][root[k]] for k in at]}

    links = kept(_met(sets, "grams").mapInArrow(_by_block(confirm, ["own", "node", "grams"], {"src": pa.int64(), "dst": pa.int64()}), "src long, dst long"), "links")
    roots = star_contraction(links).toDF("node", "root")
    classes = kept(nodes.select("node", "k1", "k2", "least").join(roots, "node", "left").select("k1", "k2", "least", F.coalesce("root", "node").alias("root")), "classes")
    first = kept(classes.groupBy("root").agg(F.min("least").alias("first")), "first")  # read anew, so that a large class can be split in the join
    by_set = classes.join(first, "root").select("k1", "k2", F.col("first.doc_id").alias("component_id"))
    found = signed.select("doc_id", "k1", "k2", "size").join(by_set, ["k1", "k2"], "left")
    component = F.when(F.col("k1").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
