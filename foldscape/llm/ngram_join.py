"""N-gram Jaccard join: all documents whose sets of word n-grams are alike enough.

MinHash bands pick candidates: of BANDS bands of ROWS minimum hashes each, chosen so that
a pair at the threshold agrees in a band with the wanted probability.  Documents with the
same set are one class from the start, so that copies, however many, are one node; sets
are told apart by 128-bit keys, and numbered.  The nodes of one band key are a bucket;
of buckets with the same nodes one stays.

Pairs are verified on the full n-gram sets, bucket by bucket, each pair in the first
bucket that both are in: what is verified are candidates alone, not what chains of
candidates lead to.  A bucket of more than BLOCK nodes (SMALL_BLOCK, up to SPREAD blocks),
or BLOCK_GRAMS n-grams, is dealt into blocks, and each two blocks meet in one task:
intersections of all their pairs are a matrix product over the n-grams that more than one
of them has.  Tasks return, for each node, how many documents it is linked to and a forest
of the links, never pairs; the forests' components are the classes.

Defined results: a text of one to n-1 words has one n-gram of all its words; a null or
empty text, or one without words, is linked to nothing; repeated rows are copies of one
another; where ids repeat or are null the class id is still the least id in the class.
A very long text's n-grams all count.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import star_contraction
from .common import chunks, flat, id_text, kept, ship
from .words import mix, shingles, words

N = 5
THRESHOLD = 0.8
#: Probability with which a pair at the threshold is a candidate.
TARGET_RECALL = 0.9995
MOST_HASHES = 128
BLOCK = 512
#: A smaller group is dealt into blocks of so many nodes too, into SPREAD blocks at most, so that no task has many more rows than others.
SMALL_BLOCK = 64
SPREAD = 8
#: N-grams of a block, about; a group of long texts is dealt into more blocks.
BLOCK_GRAMS = 1 << 20
#: N-grams that are multiplied at once.
COLUMNS = 4096


def choose_bands(threshold: float, recall: float = TARGET_RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, that reach the recall with at most so many hashes."""
    best = (most, 1)
    for rows in range(1, most + 1):
        p = threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log(1 - p)) if p < 1 else 1
        if bands * rows <= most:
            best = (bands, rows)
    return best


def _distinct(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text, ascending, and the first of each text."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], np.searchsorted(doc[keep], np.arange(len(first)))


class Sketcher:
    def __init__(self, bands: int, rows: int, n: int):
        rng = np.random.default_rng(20240501)
        self.bands, self.rows, self.n = bands, rows, n
        self.seeds = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
        self.odd = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1)

    def sets(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _distinct(*shingles(words(data, offsets), self.n))

    def sketch(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(two 64-bit keys of each non-empty set, its band keys)."""
        begin = first[:-1]
        keys = np.stack([np.add.reduceat(mix(h), begin), np.add.reduceat(mix(h ^ np.uint64(0xA0761D6478BD642F)), begin)], axis=1)
        out = np.zeros((len(begin), self.bands), dtype=np.uint64)
        for b in range(self.bands):
            key = np.full(len(begin), b + 1, dtype=np.uint64)
            for k in range(b * self.rows, (b + 1) * self.rows):
                key = mix(key * np.uint64(31) + np.minimum.reduceat((h ^ self.seeds[k]) * self.odd[k], begin))
            out[:, b] = key
        return keys, out


def _sketches(docs: DataFrame, s: Sketcher) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for i, j in chunks(offsets):
                h, first = s.sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                some = np.flatnonzero(np.diff(first))
                k1, k2 = np.zeros(j - i, dtype=np.uint64), np.zeros(j - i, dtype=np.uint64)
                sizes = np.zeros(j - i, dtype=np.int64)
                bands = np.zeros(0, dtype=np.uint64)
                if len(some):
                    keys, bands = s.sketch(h, np.append(first[some], len(h)))
                    k1[some], k2[some] = keys[:, 0], keys[:, 1]
                    sizes[some] = s.bands
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(bands.reshape(-1).view(np.int64)))
                part = batch.slice(i, j - i)
                empty = np.diff(first) == 0
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("tie"), pa.array(k1.view(np.int64), mask=empty), pa.array(k2.view(np.int64), mask=empty), pa.array(np.diff(first).astype(np.int64)), lists], ["doc_id", "tie", "k1", "k2", "size", "bands"]
                )

    return docs.mapInArrow(run, "doc_id long, tie long, k1 long, k2 long, size long, bands array<long>")


def _verify(threshold: float):
    """Over rows sorted by (bucket, x, y): the links of each node that are verified there, as (node, links, root)."""

    def links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
        sizes = np.array([len(x) for x in sets], dtype=np.int64)
        doc = np.repeat(np.arange(len(sets)), sizes)
        _, gram, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count[gram] > 1
        doc = doc[shared]
        _, gram = np.unique(gram[shared], return_inverse=True)
        order = np.argsort(gram, kind="stable")
        gram, doc = gram[order], doc[order]
        at_left, at_right = np.full(len(sets), -1), np.full(len(sets), -1)
        at_left[left], at_right[right] = np.arange(len(left)), np.arange(len(right))
        both = np.zeros((len(left), len(right)), dtype=np.float32)
        top = int(gram[-1]) + 1 if len(gram) else 0
        for a in range(0, top, COLUMNS):
            i, j = np.searchsorted(gram, [a, a + COLUMNS])
            g, d = gram[i:j] - a, doc[i:j]
            x, y = (np.zeros((n, min(COLUMNS, top - a)), dtype=np.float32) for n in (len(left), len(right)))
            ok = at_left[d] >= 0
            x[at_left[d[ok]], g[ok]] = 1
            ok = at_right[d] >= 0
            y[at_right[d[ok]], g[ok]] = 1
            both += x @ y.T
        union = sizes[left][:, None] + sizes[right][None, :] - both
        return both / union >= threshold - 1e-9

    def elsewhere(rows: list[tuple], left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which pairs are both in a bucket of a lesser number, and so verified there."""
        out = np.zeros((len(left), len(right)), dtype=bool)
        lists = [r[7] for r in rows]
        bucket, row = np.concatenate(lists), np.repeat(np.arange(len(rows)), [len(x) for x in lists])
        row = row[bucket < rows[0][0]]
        bucket = bucket[bucket < rows[0][0]]
        order = np.argsort(bucket, kind="stable")
        bucket, row = bucket[order], row[order]
        at_left, at_right = np.full(len(rows), -1), np.full(len(rows), -1)
        at_left[left], at_right[right] = np.arange(len(left)), np.arange(len(right))
        for members in np.split(row, np.flatnonzero(np.diff(bucket)) + 1):
            i, j = at_left[members], at_right[members]
            out[np.ix_(i[i >= 0], j[j >= 0])] = True
        return out

    def solve(rows: list[tuple]) -> dict[str, list]:
        x, y = rows[0][1], rows[0][2]
        own = np.array([r[3] for r in rows])
        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        here = ~elsewhere(rows, left, right)
        if x == y:
            np.fill_diagonal(here, False)
        if not here.any():
            return {"node": [], "links": [], "root": []}
        found = links([r[6] for r in rows], left, right) & here
        weight = np.array([r[5] for r in rows], dtype=np.int64)
        number = np.zeros(len(rows), dtype=np.int64)
        number[left] += found @ weight[right]
        if x != y:
            number[right] += found.T @ weight[left]
        root = np.arange(len(rows))
        while True:  # the least place that each can reach
            new = root.copy()
            new[left] = np.minimum(new[left], np.where(found, root[right][None, :], len(rows)).min(axis=1, initial=len(rows)))
            new[right] = np.minimum(new[right], np.where(found, new[left][:, None], len(rows)).min(axis=0, initial=len(rows)))
            if (new == root).all():
                break
            root = new
        at = np.flatnonzero(number).tolist()
        return {"node": [rows[k][4] for k in at], "links": number[at].tolist(), "root": [rows[root[k]][4] for k in at]}

    kinds = {"node": pa.int64(), "links": pa.int64(), "root": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: dict[str, list] = {k: [] for k in kinds}

        def done() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(out[k], type=t) for k, t in kinds.items()], list(kinds))
            for v in out.values():
                v.clear()
            return batch

        def close() -> None:
            for k, v in solve(held).items():
                out[k] += v
            held.clear()

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("bucket", "x", "y", "own", "node", "weight", "grams", "buckets")]
            for row in zip(*columns, strict=True):
                if held and held[0][:3] != row[:3]:
                    close()
                    if len(out["node"]) > 10_000:
                        yield done()
                held.append((*row[:6], np.frombuffer(row[6], dtype="<u8"), np.array(row[7], dtype=np.int64)))
        if held:
            close()
        yield done()

    return run


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, recall: float = TARGET_RECALL, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row for each document: doc_id, tie (xxhash64 of its text), class_id (the least id that links lead to),
    n_links (other documents at the threshold or more), has_words, and chosen: whether (doc_id, tie) is the least of its class."""
    spark = docs.sparkSession
    ship(spark)
    s = Sketcher(*choose_bands(threshold, recall), n)
    rows = id_text(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    sketches = kept(_sketches(rows, s), "sketches")
    # one node for each set, numbered as it is written
    nodes = kept(
        sketches.where("k1 is not null")
        .groupBy("k1", "k2")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie")).alias("least"), F.count(F.lit(1)).alias("weight"), F.first("size").alias("size"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    keyed = nodes.select("node", "size", F.posexplode("bands").alias("band", "key"))
    members = [F.bit_xor(F.xxhash64("node")).alias("a"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("b")]
    number = F.count(F.lit(1)).alias("n")
    full = keyed.groupBy("band", "key").agg(number, F.sum("size").alias("grams"), *members).where("n > 1")
    of_bucket = F.ceil(F.greatest(F.col("n") / block, F.least(F.col("n") / SMALL_BLOCK, F.lit(SPREAD)), F.col("grams") / BLOCK_GRAMS)).cast("int")
    buckets = kept(full.groupBy("n", "grams", "a", "b").agg(F.min(F.struct("band", "key")).alias("least")).select("least.*", of_bucket.alias("blocks"), F.monotonically_increasing_id().alias("bucket")), "buckets")
    inside = keyed.join(buckets, ["band", "key"]).groupBy("node").agg(F.collect_list(F.struct("bucket", "blocks")).alias("inside"))  # one for each band at most
    dealt = nodes.select("node", "weight", "least.doc_id", "least.tie").join(inside, "node")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node", "weight", "inside"]
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for i, j in chunks(offsets):
                h, first = s.sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                grams = [h[a:z].astype("<u8").tobytes() for a, z in zip(first[:-1], first[1:], strict=True)]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(grams, type=pa.binary())], [*names, "grams"])

    of_nodes = (
        rows.alias("r")
        .join(dealt.hint("merge").alias("d"), F.col("r.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("r.tie") == F.col("d.tie")))
        .select("node", "weight", "inside", "text")
    )
    if _repeats(sketches):
        of_nodes = of_nodes.dropDuplicates(["node"])
    met = (
        of_nodes.mapInArrow(sets, "node long, weight long, inside array<struct<bucket:long,blocks:int>>, grams binary")
        .withColumns({"of": F.explode("inside"), "buckets": F.col("inside.bucket")})
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("of.blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of.blocks") - 1)))
        .select("of.bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "weight", "grams", "buckets")
        .repartition("bucket", "x", "y")
        .sortWithinPartitions("bucket", "x", "y", "node")
    )
    verified = kept(met.mapInArrow(_verify(threshold), "node long, links long, root long"), "verified")
    roots = star_contraction(verified.where("node != root").select(F.col("node").alias("src"), F.col("root").alias("dst"))).toDF("node", "root")
    counted = verified.groupBy("node").agg(F.sum("links").alias("links"))
    linked = (
        nodes.drop("bands")
        .join(counted, "node", "left")
        .join(roots, "node", "left")
        .select("k1", "k2", "least", (F.coalesce("links", F.lit(0).cast("long")) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
        .where("n_links > 0")
    )
    linked = kept(linked, "linked")
    leasts = kept(linked.groupBy("root").agg(F.min("least").alias("first")), "leasts")  # read anew, so that a large class can be split in the join
    classes = linked.join(leasts, "root").select("k1", "k2", "n_links", "first")
    return (
        sketches.drop("bands", "size")
        .join(classes, ["k1", "k2"], "left")
        .select(
            "doc_id",
            "tie",
            F.when(F.col("n_links").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
            F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
            F.col("k1").isNotNull().alias("has_words"),
            F.when(F.col("first").isNull(), True).otherwise(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tie") == F.col("first.tie"))).alias("chosen"),
        )
    )


def _repeats(sketches: DataFrame) -> bool:
    """Whether an id stands with the same text more than once."""
    return not sketches.groupBy("doc_id", "tie").count().where("count > 1").isEmpty()


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, one of each class: that with the least id; of rows with its id and text, the least row. All columns pass through."""
    judged = kept(jaccard_classes(docs, threshold, n, id_col=id_col, text_col=text_col), "classes")
    names = docs.columns
    key, tie = (next(x for x in (base + "_" * k for k in range(len(names) + 1)) if x not in names) for base in ("own_id", "own_tie"))
    out = docs.withColumns({key: F.col(id_col).cast("long"), tie: F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))})

    def marked(rows: DataFrame, how: str, by: DataFrame) -> DataFrame:
        by = by.select(F.col("doc_id").alias("by_id"), F.col("tie").alias("by_tie")).distinct().hint("merge")  # the same plan at every size
        return rows.join(by, rows[key].eqNullSafe(by["by_id"]) & (rows[tie] == by["by_tie"]), how)

    out = marked(out, "left_anti", judged.where("not chosen"))
    repeated = judged.where("has_words").groupBy("doc_id", "tie").count().where("count > 1")
    if not repeated.isEmpty():
        one = marked(out, "left_semi", repeated).groupBy(key, tie).agg(F.min(F.struct(*[f"`{c}`" for c in names])).alias("row")).select("row.*")
        return marked(out, "left_anti", repeated).select(*[f"`{c}`" for c in names]).unionByName(one)
    return out.select(*[f"`{c}`" for c in names])
