"""Embedding whitening: coordinates on the leading principal components, with unit variances.

Entries become whole numbers, x = floor(SCALE c).  The components are those of the fit list: each distinct x vector once.
Two passes over it: the first sums x exactly, which gives the mean; the second sums outer products of centred rows by one
matrix product for each block of rows.  Tasks return one small row each, merged by treeAggregate; LAPACK's symmetric solver
gives the components, and a matrix of (dimensions x components) goes back to the tasks.  A third pass measures how far the
covariance of the whitened fit list is from the identity.

Defined results: rows whose vector is null, or holds a null or a number that is not finite, are left out, as are those of
another length than most distinct vectors have (of lengths equally common the largest), empty vectors among them; whole numbers
beyond 64 bits become the largest ones.  Components whose variance is within rounding of zero can't be whitened and are left out,
so that a table with one distinct vector has no component; an empty table has none.  Repeated rows and ids are each kept.
deviation is null where it has more than 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, ship

SCALE = 256
COMPONENTS = 4
#: Share of the variance of the first component below which a variance is rounding alone.
ROUNDING = 1e-12
#: Rows of one matrix product.
ROWS = 4096
_LIMB = 24


def whole_numbers(column: pa.Array, scale: int = SCALE) -> tuple[np.ndarray, list[np.ndarray]]:
    """(places of the rows that are finite throughout, their vectors as int64) of a column of lists."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().cast(pa.float64())
    c = values.fill_null(np.nan).to_numpy(zero_copy_only=False)
    first = np.cumsum(sizes) - sizes
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(c))])
    ok = column.is_valid().to_numpy(zero_copy_only=False) & (bad[first + sizes] == bad[first])
    with np.errstate(invalid="ignore", over="ignore"):
        big = np.floor(np.where(np.isfinite(c), c, 0.0) * scale)
        limit = float(2**63)
        x = np.where(big >= limit, np.iinfo(np.int64).max, np.where(big <= -limit, np.iinfo(np.int64).min, np.where(np.abs(big) < limit, big, 0).astype(np.int64)))
    at = np.flatnonzero(ok)
    if n and len(at) and (sizes[at] == sizes[at[0]]).all():
        d = int(sizes[at[0]])
        return at, list(x[(first[at][:, None] + np.arange(d)[None, :])])
    return at, [x[first[k] : first[k] + sizes[k]] for k in at]


def _coded(rows: DataFrame) -> DataFrame:
    """dims, x (little-endian, of 4 bytes each where all fit, else 8) of the rows that count. rows: vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, x = whole_numbers(b.column("vector"))
            raw = [v.astype("<i4").tobytes() if not len(v) or (v == v.astype("<i4")).all() else v.astype("<i8").tobytes() for v in x]
            yield pa.RecordBatch.from_arrays([pa.array([len(v) for v in x], pa.int32()), pa.array(raw, pa.binary())], ["dims", "x"])

    return rows.mapInArrow(run, "dims int, x binary")


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    """The vectors of `_coded` as int64 matrices of ROWS rows at most."""
    for b in batches:
        raw = b.column("x").to_pylist()
        for a in range(0, len(raw), ROWS):
            part = raw[a : a + ROWS]
            short = [r for r in part if len(r) == 4 * d]
            if short:
                yield np.frombuffer(b"".join(short), dtype="<i4").reshape(-1, d).astype(np.int64)
            if len(short) < len(part):
                yield np.frombuffer(b"".join(r for r in part if len(r) != 4 * d), dtype="<i8").reshape(-1, d)


def _merge(fit: DataFrame, work, schema: str, zero, add):
    """work makes one row of each task; they are added up on the executors, tree-wise, and one result comes to the driver."""
    return fit.mapInArrow(work, schema).rdd.treeAggregate(zero, add, add)


@dataclass
class Whitening:
    """What whitens: n distinct vectors, their sums, the projection (dimensions x components, over sqrt of the variances), shares of the variance."""

    n: int = 0
    sums: list[int] = field(default_factory=list)
    projection: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    explained: list[float] = field(default_factory=list)
    variances: list[float] = field(default_factory=list)
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n)) for s in self.sums])

    def deviations(self, x: np.ndarray) -> list[Decimal | None]:
        """Of each row the sum over dimensions of (n x - S)^2, exact."""
        n, d = self.n, max(x.shape[1], 1)
        top = int(np.abs(x.astype(object)).max(initial=0)) if x.size else 0
        reach = n * top + max((abs(s) for s in self.sums), default=0)
        if reach * reach * d < 2**63:
            y = n * x - np.array(self.sums, dtype=np.int64)
            return [Decimal(v) for v in (y * y).sum(axis=1).tolist()]
        if top < 2**28:  # n^2 x.x - 2 n x.S + S.S, S by limbs of 24 bits, so that every product fits
            squares = (x * x).sum(axis=1).tolist()
            cross = [0] * len(x)
            for k in range(max(abs(s).bit_length() for s in self.sums) // _LIMB + 1):
                limb = np.array([(1 if s >= 0 else -1) * ((abs(s) >> (_LIMB * k)) & ((1 << _LIMB) - 1)) for s in self.sums], dtype=np.int64)
                cross = [c + (v << (_LIMB * k)) for c, v in zip(cross, (x @ limb).tolist(), strict=True)]
            own = sum(s * s for s in self.sums)
            found = [n * n * a - 2 * n * b + own for a, b in zip(squares, cross, strict=True)]
        else:
            found = [sum((n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [Decimal(v) if v < 10**38 else None for v in found]


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS, vector_col: str = "embedding") -> Whitening:
    """Fits the leading components, at most so many, to the distinct whole-number vectors."""
    ship(vectors.sparkSession)
    fit = kept(_coded(vectors.select(F.col(vector_col).alias("vector"))).distinct(), "fit")
    most = fit.where("dims > 0").groupBy("dims").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if most is None:
        return Whitening()
    d, n = most["dims"], most["n"]
    fit = fit.where(F.col("dims") == d).select("x")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * d
        for x in _blocks(batches, d):
            small = np.abs(x // 2**31).max(initial=0) <= 1  # so that a block's sum fits
            total = [a + b for a, b in zip(total, (x if small else x.astype(object)).sum(axis=0).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([[str(v) for v in total]])], ["sums"])

    got = _merge(fit, sums, "sums array<string>", [0] * d, lambda a, b: [x + int(y) for x, y in zip(a, b["sums"] if hasattr(b, "sums") else b, strict=True)])
    made = Whitening(n=n, sums=got)
    mean = made.mean

    def squares(centred) -> np.ndarray:
        """Sum of outer products of centred(x) over the fit list."""

        def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for x in _blocks(batches, d):
                y = centred(x)
                total = y.T @ y if total is None else total + y.T @ y
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["products"])

        def add(a: np.ndarray, b) -> np.ndarray:
            return a + (np.frombuffer(b["products"]) if hasattr(b, "products") else b)

        flat = _merge(fit, products, "products binary", np.zeros(1), add)
        size = int(round(len(flat) ** 0.5))
        return flat.reshape(size, size)

    covariance = squares(lambda x: x - mean) / n
    covariance = (covariance + covariance.T) / 2
    values, vectors_ = np.linalg.eigh(covariance)
    order = np.argsort(values)[::-1][:components]
    order = order[values[order] > ROUNDING * max(values.max(), 0.0)]
    made.variances = values[order].tolist()
    made.explained = (values[order] / np.trace(covariance)).tolist() if len(order) else []
    made.projection = vectors_[:, order] / np.sqrt(values[order])
    if len(order):
        projection = made.projection
        made.identity_error = float(np.abs(squares(lambda x: (x - mean) @ projection) / n - np.eye(len(order))).max())
    return made


def whiten(vectors: DataFrame, w: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, whitened (a double for each component), deviation (decimal, exact) of the rows that count; no shuffle."""
    ship(vectors.sparkSession)
    d, mean = len(w.sums), w.mean if w.n else None
    given = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    kind = given.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = whole_numbers(b.column("vector"))
            keep = [k for k, v in enumerate(x) if d and len(v) == d]
            for a in range(0, len(keep), ROWS):
                some = keep[a : a + ROWS]
                m = np.stack([x[k] for k in some])
                z = (m - mean) @ w.projection
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at[some])), lists, pa.array(w.deviations(m), pa.decimal128(38, 0))], ["id", "whitened", "deviation"])

    return given.mapInArrow(run, f"id {kind}, whitened array<double>, deviation decimal(38,0)").withColumnRenamed("id", id_col)
