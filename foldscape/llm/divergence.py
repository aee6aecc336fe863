"""Source divergence audit: how far each source of a language is from every other, and the terms that set it apart.

A term is a run of letters (bytes beyond ASCII count as letters), A-Z lower-cased; a language keeps the V terms that are in
at least so many of its documents.  With a count c, c or more occurrences, out of N of all kept terms, a term's smoothed
share is p = 1 + floor(SCALE (c + 2) / (N + 2 V)), and f(p, q) = floor((p - q)^2 / (p + q)).  The distance of two sources
is the sum of f over all kept terms, zero counts among them.

Nothing is dense in the terms: a pair begins at V f(p0, q0), as if no term occurred in either; an inverted index of postings
(term, source, p) adds corrections where a count is not zero,
    one source has it:  f(p, q0) - f(p0, q0), by each source's distinct values of p;
    both have it:       f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0).
The sources of a language are dealt into tiles, its terms into blocks; each two tiles meet in one task for each block, which
returns a sum for each pair with a correction there.  All numbers are integers.

Defined results: null texts, languages and sources are empty strings; a source without kept terms has zero counts of all of
them; a language that keeps no term has distances of 0; a source alone in its language has no pair; an empty table gives no
row.  A very long text is worked on whole.  Repeated rows count each time.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import numbered
from .common import chunks, flat, kept, ship
from .tokens import LETTERS, as_strings, runs

SCALE = 1_000_000_000
#: Documents of a language that a term must be in.
LEAST_DOCS = 10
#: Sources of a tile, postings of a block of terms (about), and pairs of postings at once.
TILE, BLOCK_ROWS, PAIRS = 512, 1 << 18, 1 << 20
#: Bytes of text at once, and rows of counts that a task holds before it hands them on.
CHUNK, HELD = 3 << 20, 1 << 19

COUNTS = "lang string, source string, term string, count long, docs long"


def _run_lengths(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of ascending ones, and how often each stands."""
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, dtype=np.int64)
    return ordered[first], np.diff(np.append(first, len(ordered)))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count (occurrences), docs (documents with it), summed up in each task; and a row with an empty term for each
    language and source, so that those without terms are there too. docs: lang, source, text, none null. Sums over tasks are still to be made."""
    ship(docs.sparkSession)
    held_as = pa.schema([("group", pa.int64()), ("term", pa.large_string()), ("count", pa.int64()), ("docs", pa.int64())])

    def count(batch: pa.RecordBatch, number: dict[tuple[str, str], int]) -> Iterator[pa.Table]:
        """group (numbers given to languages and sources as they come), term, count, docs of a batch, piece by piece."""
        data, offsets = flat(batch.column("text"))
        names = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
        of_doc = np.array([number.setdefault(x, len(number)) for x in names], dtype=np.int64)
        for i, j in chunks(offsets, CHUNK):
            letters, sizes, doc, _ = runs(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], LETTERS)
            words = as_strings(letters, sizes).dictionary_encode()
            most = max(len(words.dictionary), 1)
            key, times = _run_lengths(np.sort(doc * most + words.indices.to_numpy()))  # each document's terms
            key = of_doc[i:j][key // most] * most + key % most
            order = np.argsort(key, kind="stable")
            times = np.concatenate([[0], np.cumsum(times[order])])
            key, docs_with = _run_lengths(key[order])
            times = np.diff(times[np.concatenate([[0], np.cumsum(docs_with)])])
            groups = np.unique(of_doc[i:j])
            none = np.zeros(len(groups), dtype=np.int64)
            terms = pa.concat_arrays([pa.array([""] * len(groups), pa.large_string()), words.dictionary.take(pa.array(key % most))])
            yield pa.table([np.concatenate([groups, key // most]), terms, np.concatenate([none, times]), np.concatenate([none, docs_with])], held_as.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[tuple[str, str], int] = {}
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            t = pa.concat_tables(held).group_by(["group", "term"], use_threads=False).aggregate([("count", "sum"), ("docs", "sum")])
            return t.rename_columns(held_as.names)

        def out() -> Iterator[pa.RecordBatch]:
            known = list(number)
            lang, source = (pa.array([x[k] for x in known], pa.string()) for k in (0, 1))
            for b in merged().to_batches(max_chunksize=1 << 14):
                at = b.column("group")
                yield pa.RecordBatch.from_arrays([lang.take(at), source.take(at), b.column("term").cast(pa.string()), b.column("count"), b.column("docs")], ["lang", "source", "term", "count", "docs"])
            held.clear()

        for batch in batches:
            if not held:
                number.clear()
            for t in count(batch, number):
                held.append(t.cast(held_as))
                if sum(map(len, held)) > HELD:
                    held[:] = [merged()]
                    if len(held[0]) > HELD // 2:
                        yield from out()
        if held:
            yield from out()

    return docs.mapInArrow(run, COUNTS)


def share(count: Column, n: Column, v: Column) -> Column:
    """The smoothed share of a count, exact however large; 1 where no term is kept."""
    big = lambda c: c.cast("decimal(20,0)")
    whole = F.call_function("div", F.lit(SCALE).cast("decimal(11,0)") * big(count + 2), big(n) + 2 * v.cast("decimal(18,0)"))
    return F.when(v > 0, 1 + whole).otherwise(F.lit(1)).cast("long")


def apart(p: Column, q: Column) -> Column:
    """f of two shares."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def f_of(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def _tile_sums(left0: np.ndarray, right0: np.ndarray, left: tuple, right: tuple, v: int, same: bool) -> np.ndarray:
    """The sums of one block of terms for each pair of a source of one tile and one of another.

    left0, right0: the sources' shares of a zero count; left, right: postings as (source's place, share, term) arrays, sorted by term;
    v: the number of terms whose zero counts begin the sum, 0 in all blocks but one; same: both tiles are the same one.
    """
    base = f_of(left0[:, None], right0[None, :])
    total = v * base

    def one_has_it(rows: tuple, other: np.ndarray, base: np.ndarray, total: np.ndarray) -> None:
        place, p = rows[0], rows[1]
        order = np.lexsort((p, place))
        place, p = place[order], p[order]
        first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (p[1:] != p[:-1])])) if len(p) else place
        times = np.diff(np.append(first, len(p)))
        place, p = place[first], p[first]
        step = max(1, PAIRS // max(len(other), 1))
        for a in range(0, len(p), step):
            at = place[a : a + step]
            np.add.at(total, at, (f_of(p[a : a + step, None], other[None, :]) - base[at]) * times[a : a + step, None])

    one_has_it(left, right0, base, total)
    if same:
        total += total.T - v * base  # the other one has it: the same sums, the other way round
    else:
        one_has_it(right, left0, base.T, total.T)
    lp, lv, lt = left
    rp, rv, rt = right
    begin, end = np.searchsorted(rt, lt, "left"), np.searchsorted(rt, lt, "right")
    many = np.cumsum(end - begin)  # pairs up to each posting of the left tile
    a = 0
    while a < len(lt):
        z = max(a + 1, int(np.searchsorted(many, (many[a - 1] if a else 0) + PAIRS, "right")))
        n = (end - begin)[a:z]
        i = np.repeat(np.arange(a, z), n)
        j = np.repeat(begin[a:z], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if same:
            i, j = i[lp[i] < rp[j]], j[lp[i] < rp[j]]
        x, y = lp[i], rp[j]
        np.add.at(total, (x, y), f_of(lv[i], rv[j]) - f_of(lv[i], right0[y]) - f_of(left0[x], rv[j]) + base[x, y])
        a = z
    return total


def _tiles(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """a < b (numbers of sources), value: the sums of each pair by blocks of terms.

    postings: number, tile, tiles, blocks, lang, term, p; groups: number, tile, tiles, blocks, lang, p0, v.
    """
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    meet = [F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y")]
    rows = postings.withColumn("other", other).select("lang", *meet, F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "tile", "number", F.lit(None).cast("long").alias("p0"), F.lit(None).cast("long").alias("v"), "term", "p")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    members = groups.withColumn("other", other).withColumn("block", every).select("lang", *meet, "block", "tile", "number", "p0", F.when(F.col("block") == 0, F.col("v")).otherwise(0).alias("v"), F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("p"))

    def sums(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        x, y, block = (t.column(c)[0].as_py() for c in ("x", "y", "block"))
        tile, number = t.column("tile").to_numpy(), t.column("number").to_numpy()
        is_member = t.column("p0").is_valid().to_numpy()
        term = t.column("term").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        p0, p, v = (t.column(c).fill_null(0).to_numpy() for c in ("p0", "p", "v"))

        def side(of: int) -> tuple:
            m = np.flatnonzero(is_member & (tile == of))
            m = m[np.argsort(number[m])]
            r = np.flatnonzero(~is_member & (tile == of))
            r = r[np.argsort(term[r], kind="stable")]
            return number[m], p0[m], (np.searchsorted(number[m], number[r]), p[r], term[r])

        (ln, l0, left), (rn, r0, right) = side(x), side(y)
        total = _tile_sums(l0, r0, left, right, int(v.max(initial=0)), x == y)
        found = np.triu(np.ones(total.shape, dtype=bool), 1) if x == y else np.ones(total.shape, dtype=bool)
        i, j = np.nonzero(found if block == 0 else found & (total != 0))
        return pa.table([pa.array(ln[i]), pa.array(rn[j]), pa.array(total[i, j])], ["a", "b", "value"])

    return rows.unionByName(members).groupBy("lang", "x", "y", "block").applyInArrow(sums, "a long, b long, value long")


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = 10, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: part 'pair' has every other source of the language by distance, part 'term' the `top` kept terms
    whose share in the source is above that in the language, by f. Ranks from 1, values descending, items in the order of their UTF-8 bytes."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    given = docs.select(empty(lang_col).alias("lang"), empty(source_col).alias("source"), empty(text_col).alias("text"))
    counts = kept(term_counts(given).groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")), "counts")
    real = counts.where("term != ''")
    terms = kept(real.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("total")).where(F.col("docs") >= least_docs).drop("docs"), "terms")
    found = kept(real.drop("docs").join(terms, ["lang", "term"]), "found")
    of_lang = terms.groupBy("lang").agg(F.sum("total").alias("n_lang"), F.count(F.lit(1)).alias("v"))
    of_source = found.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("postings"))
    sources = numbered(counts.where("term = ''").select("lang", "source"), "number", ["lang", "source"])
    known = kept(sources.join(of_source, ["lang", "source"], "left").join(of_lang, ["lang"], "left").fillna(0, ["n", "n_lang", "v", "postings"]), "sources")
    sizes = known.groupBy("lang").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("sources"), F.sum("postings").alias("rows"))
    groups = kept(
        known.join(sizes, "lang").select(
            "lang", "source", "number", "n", "n_lang", "v", share(F.lit(0), F.col("n"), F.col("v")).alias("p0"),
            F.call_function("div", F.col("number") - F.col("first"), F.lit(TILE)).alias("tile"), F.ceil(F.col("sources") / TILE).alias("tiles"),
            F.greatest(F.lit(1), F.ceil(F.col("rows") / BLOCK_ROWS)).alias("blocks"),
        ), "groups",
    )
    postings = found.join(groups, ["lang", "source"]).withColumn("p", share(F.col("count"), F.col("n"), F.col("v")))

    sums = kept(_tiles(postings, groups).groupBy("a", "b").agg(F.sum("value").alias("value")), "sums")
    both = sums.unionByName(sums.select(F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    name = lambda n, c: groups.select(F.col("number").alias(n), *c)
    pairs = both.join(name("a", ["lang", "source"]), "a").join(name("b", [F.col("source").alias("item")]), "b").select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    own = share(F.col("total"), F.col("n_lang"), F.col("v"))
    above = postings.withColumn("q", own).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(above.withColumn("rank", rank).where(F.col("rank") <= top))
