"""Toxicity by two class-conditional Kneser-Ney models of the characters of words.

A word is read with a start and an end mark.  For class c (toxic or ordinary), a symbol x
after the ORDER - 1 symbols h, with N_c the class's counts and kinds_c(h) the different
symbols that it has after h,

    P_c(x | h) = (max(N_c(h x) - D, 0) + (S + D * kinds_c(h)) * P(x | h)) / (S + N_c(h))

P is one interpolated Kneser-Ney model of both classes together (absolute discount D, below
the highest order the numbers of different symbols seen before, at last 1/256 for each
byte): both classes back off to the same counts, so that what is rare in both says little
of either.  S, the strength of the backoff, counts as so many symbols of either class.

A toxic text is ordinary prose in which a share MIX of the words is toxic, so with the
product over a word's symbols as P_c(word),

    feature = 1 / (words + PAD) * sum over the words of log((1 - MIX) P_ordinary(word) + MIX P_toxic(word)) - log P_ordinary(word)

the difference of the length-normalised log-likelihoods; PAD words that say nothing are
added, so that one odd word does not make a short text toxic.  A logistic function of the
feature, fitted on labelled rows that the models haven't seen, is the score; in that fit
the classes' weights are halfway (by ratio) between their shares and equal ones.

Fitting takes whole documents, at most MAX_PER_CLASS of each class by the order of a hash
of their id: a bounded, documented sample, fitted in one task.  Everything else runs over
all rows: each task scores its texts with the model from the shared folder.

Defined results: a null or empty text, or one without words, has feature 0 and the score
that belongs to it; where one class has no labelled row, every score is the share of toxic
ones, and 0 if there is no labelled row; repeated documents are each scored; a document
with several labels is toxic if any is 1.  A very long text is scored by all of its words.  Other columns pass through.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import add_from_text, chunks, filesystem, flat, shared_folder, ship, write_bytes
from .words import LOWER, words

MAX_PER_CLASS = 8000
# ORDER, STRENGTH, MIX and PAD have the best recall at a false-positive rate of 0.01 on rows of remainder 4, with models fitted
# on those of remainders 1 to 3 of crc32(doc_id) modulo 5 (sf0.1): rows of remainder 0 had no part in this choice.
ORDER = 8
DISCOUNT = 0.75
STRENGTH = 10.0
MIX = 0.01
PAD = 10
#: Every so manieth labelled row is kept from the models, to fit the logistic function.
CALIBRATE = 4
#: Words whose value a worker remembers.
REMEMBERED = 1 << 19
_START, _END = 1, 2
_BYTE = np.uint64(8)


def grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(grams of every symbol of the words data[starts[i]:ends[i]], first gram of each word): `order` symbols as bytes of one integer, the last lowest."""
    sizes = ends - starts + 1  # the end mark too
    first = np.concatenate([[0], np.cumsum(sizes)])
    word = np.repeat(np.arange(len(starts)), sizes)
    at = np.arange(first[-1]) - first[word]
    symbol = np.full(len(at), _END, dtype=np.uint64)
    inner = at < sizes[word] - 1
    symbol[inner] = LOWER[data[(starts[word] + at)[inner]]]
    out = symbol.copy()
    for k in range(1, order):
        back = np.full(len(at), _START, dtype=np.uint64)
        ok = np.flatnonzero(at >= k)
        back[ok] = symbol[ok - k]
        out |= back << np.uint64(8 * k)
    return out, first


def _sum(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their values."""
    u, inverse = np.unique(keys, return_inverse=True)
    return u, np.bincount(inverse, weights=values, minlength=len(u))


def _look(table: tuple[np.ndarray, np.ndarray], asked: np.ndarray, other: float = 0.0) -> np.ndarray:
    """The values of asked keys; keys are sorted."""
    keys, values = table
    if not len(keys):
        return np.full(len(asked), other)
    k = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[k] == asked, values[k], other)


def pooled(counted: tuple[np.ndarray, np.ndarray], order: int, discount: float = DISCOUNT) -> np.ndarray:
    """The interpolated Kneser-Ney probability of each counted gram's last symbol after those ahead of it."""
    ends = lambda g, k: g & np.uint64((1 << (8 * k)) - 1)
    levels = [counted]
    for k in range(order - 1, 0, -1):
        shorter = ends(levels[-1][0], k)
        levels.append(_sum(shorter, np.ones(len(shorter))))
    value = np.zeros(0)
    for k, (g, n) in enumerate(reversed(levels), start=1):
        _, at = np.unique(g >> _BYTE, return_inverse=True)
        size, kinds = np.bincount(at, n), np.bincount(at)
        lower = value[np.searchsorted(levels[order - k + 1][0], ends(g, k - 1))] if k > 1 else np.full(len(g), 1 / 256)
        value = (np.maximum(n - discount, 0) + discount * kinds[at] * lower) / size[at]
    return value


class Model:
    """log P_toxic - log P_ordinary of every gram: a value for those that a class has, one for each context of the others, else 0."""

    def __init__(self, counted: list[tuple[np.ndarray, np.ndarray]], order: int = ORDER, discount: float = DISCOUNT, strength: float = STRENGTH, mix: float = MIX):
        """counted: (gram of `order` symbols, count) of the ordinary and the toxic class."""
        self.order, self.mix = order, mix
        g, n = _sum(*(np.concatenate(x) for x in zip(*counted, strict=True)))
        shared = pooled((g, n), order, discount)
        contexts, at = np.unique(g >> _BYTE, return_inverse=True)
        value, backoff = [], []
        for table in counted:
            own = _look(_sum(*table), g)
            size, kinds = np.bincount(at, own), np.bincount(at, own > 0)
            share = (strength + discount * kinds) / (strength + size)
            value.append(np.log(np.maximum(own - discount, 0) / (strength + size[at]) + share[at] * shared))
            backoff.append(np.log(share))
        self.grams = g, (value[1] - value[0]).astype(np.float32)
        self.contexts = contexts, (backoff[1] - backoff[0]).astype(np.float32)

    def of_grams(self, asked: np.ndarray) -> np.ndarray:
        """The log ratio of each gram of the highest order. Of one that no class has, the shared probability cancels out."""
        keys, values = self.grams
        if not len(keys):
            return np.zeros(len(asked))
        k = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        seen = keys[k] == asked
        out = values[k].astype(float)
        out[~seen] = _look(self.contexts, asked[~seen] >> _BYTE)
        return out

    def of_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """What each word adds to the feature's sum, by its distinct grams."""
        if not len(starts):
            return np.zeros(0)
        g, first = grams(data, starts, ends, self.order)
        distinct, inverse = np.unique(g, return_inverse=True)
        ratio = np.add.reduceat(self.of_grams(distinct)[inverse], first[:-1])
        return np.logaddexp(np.log1p(-self.mix), np.log(self.mix) + ratio)


def count_grams(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The grams of the words of some texts, and how often each occurs."""
    keys, n = [], []
    held = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int64)
    data = np.frombuffer(b"".join(held), dtype=np.uint8)
    for i, j in chunks(offsets):
        part = data[offsets[i] : offsets[j]]
        w = words(part, offsets[i : j + 1] - offsets[i], hashed=False)
        g, _ = grams(part, w.starts, w.ends, order)
        u, c = np.unique(g, return_counts=True)
        keys.append(u), n.append(c)
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0)
    return _sum(np.concatenate(keys), np.concatenate(n))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic regression, by Newton's method with a light penalty."""
    theta, unit = np.zeros(2), float(x.std()) or 1.0
    z = np.stack([x / unit, np.ones(len(x))], axis=1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
        gradient = z.T @ (weight * (y - p)) - 1e-3 * theta
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        step = np.clip(np.linalg.solve(hessian, gradient), -5, 5)
        theta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]) / unit, float(theta[1])


class Scorer:
    """Model, slope and intercept; without a model, the score is the sigmoid of the intercept."""

    def __init__(self, model: Model | None, slope: float, intercept: float):
        self.model, self.slope, self.intercept = model, slope, intercept
        self.known = (np.zeros(0, np.uint64), np.zeros(0))  # hashes of words and their values

    def features(self, column: pa.Array) -> np.ndarray:
        data, offsets = flat(column)
        out = np.zeros(len(column))
        if self.model is None:
            return out
        for i, j in chunks(offsets):
            part = data[offsets[i] : offsets[j]]
            w = words(part, offsets[i : j + 1] - offsets[i])
            hashes, at, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
            keys, values = self.known
            k = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0))
            seen = keys[k] == hashes if len(keys) else np.zeros(len(hashes), bool)
            value = np.zeros(len(hashes))
            value[seen] = values[k[seen]]
            value[~seen] = self.model.of_words(part, w.starts[at[~seen]], w.ends[at[~seen]])
            if len(keys) > REMEMBERED:
                keys, values, seen = keys[:0], values[:0], np.zeros(len(hashes), bool)
            place = np.searchsorted(keys, hashes[~seen])
            self.known = (np.insert(keys, place, hashes[~seen]), np.insert(values, place, value[~seen]))
            sums = np.concatenate([[0.0], np.cumsum(value[inverse])])
            out[i:j] = (sums[w.first[1:]] - sums[w.first[:-1]]) / (np.diff(w.first) + PAD)
        return out

    def __call__(self, column: pa.Array) -> np.ndarray:
        if self.model is None:
            return np.full(len(column), self.intercept)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.features(column) + self.intercept, -30, 30)))


def make_scorer(fit: dict[int, list[str]], held: dict[int, list[str]], share: float) -> Scorer:
    """fit and held: texts by label; share: of toxic rows among all labelled ones."""
    if not (fit[0] and fit[1]):
        return Scorer(None, 0.0, share)
    model = Model([count_grams(fit[0]), count_grams(fit[1])])
    probe = Scorer(model, 1.0, 0.0)
    if not (held[0] and held[1]):
        held = fit  # too few rows to keep some aside
    x = {c: probe.features(pa.array(held[c], type=pa.large_string())) for c in (0, 1)}
    weights = [np.sqrt(w / len(x[c])) for c, w in ((0, 1 - share), (1, share))]
    weight = np.concatenate([np.full(len(x[c]), weights[c] / max(weights)) for c in (0, 1)])
    return Scorer(model, *fit_logistic(np.concatenate([x[0], x[1]]), np.repeat([0.0, 1.0], [len(x[0]), len(x[1])]), weight))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> str:
    """Fits on the labelled rows given, a bounded sample of them; returns the URI of the model."""
    spark = docs.sparkSession
    ship(spark)
    uri = shared_folder(spark, "toxicity") + "/model.pickle"
    marked = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label")).withColumn("order", F.xxhash64("id"))
    numbers = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    share = numbers.get(1, 0) / max(1, sum(numbers.values()))
    chosen = marked.where("label = 0").orderBy("order", "id").limit(MAX_PER_CLASS).union(marked.where("label = 1").orderBy("order", "id").limit(MAX_PER_CLASS))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")  # at most 2 * MAX_PER_CLASS ids

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[tuple[int, int, str]] = []
        for b in batches:
            texts += zip(b.column("order").to_pylist(), b.column("label").to_pylist(), b.column("text").to_pylist(), strict=True)
        texts.sort()
        kept = {c: [t for o, k, t in texts if k == c and o % CALIBRATE] for c in (0, 1)}
        held = {c: [t for o, k, t in texts if k == c and not o % CALIBRATE] for c in (0, 1)}
        scorer = make_scorer(kept, held, share)
        write_bytes(uri, [pickle.dumps((scorer.model, scorer.slope, scorer.intercept))])
        yield pa.RecordBatch.from_pydict({"n": pa.array([len(texts)], type=pa.int64())})

    if not rows.select("order", "label", "text").repartition(1).mapInArrow(fit, "n long").collect():
        write_bytes(uri, [pickle.dumps((None, 0.0, share))])
    return uri


_scorers: dict[str, Scorer] = {}


def score_toxicity(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """Adds score (0 to 1) and predicted (1 where score >= 0.5)."""

    def work(columns: Iterator[pa.Array]) -> Iterator[list[pa.Array]]:
        if model not in _scorers:
            where, path = filesystem(model)
            with where.open_input_file(path) as f:
                _scorers[model] = Scorer(*pickle.loads(f.read()))
        for column in columns:
            score = _scorers[model](column)
            yield [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]

    return add_from_text(docs, work, "score double, predicted int", text_col)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5: such rows are never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
