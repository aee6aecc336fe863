"""Column expressions: sequences, triangles, statistics and their text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import Params

#: Ordered complementary pairs.
COMPLEMENTARY = ("AU", "UA", "GC", "CG", "GU", "UG")


def normalize_sequence(text: Column) -> Column:
    """Upper case, T as U, all but A, U, G and C left out."""
    return F.regexp_replace(F.translate(F.upper(text), "T", "U"), "[^AUGC]", "")


def shuffled_letters(text: Column, *seeds: Column) -> Column:
    """The letters in an order by a hash of place and seeds: the same permutation for the same seeds on any machine."""
    letters = F.filter(F.split(text, ""), lambda x: x != "")
    marked = F.transform(letters, lambda x, i: F.struct(F.xxhash64(i, *seeds).alias("h"), i.alias("i"), x.alias("x")))
    return F.array_join(F.transform(F.array_sort(marked), lambda s: s["x"]), "")


def set_key(ids: Column) -> Column:
    """Order-free 64-bit key of a set of numbers: removing one is an exclusive or with its hash."""
    return F.aggregate(ids, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(F.xxhash64(x)))


def triangle_label(d1: Column, d2: Column, d3: Column, p: Params = Params()) -> Column:
    """nontrivial, trivial or non_ultrametric, by the sorted sides; a side that is no number or infinite is non_ultrametric."""
    low, high = F.least(d1, d2, d3), F.greatest(d1, d2, d3)
    mid = F.greatest(F.least(d1, d2), F.least(F.greatest(d1, d2), d3))
    odd = F.isnan(d1) | F.isnan(d2) | F.isnan(d3) | (high == float("inf")) | d1.isNull() | d2.isNull() | d3.isNull()
    return (
        F.when(odd, "non_ultrametric")
        .when(high <= p.tolerance, "trivial")
        .when((mid > p.tolerance) & (F.try_divide(high - mid, mid) <= p.epsilon) & (F.try_divide(mid - low, mid) > p.delta), "nontrivial")
        .when((low > p.tolerance) & (F.try_divide(high - low, low) <= p.epsilon), "trivial")
        .otherwise("non_ultrametric")
    )


def half_even(value: Column) -> Column:
    """Rounded to a whole number, halves to the even one."""
    return F.bround(value, 0).cast("long")


def sample_std(value: Column) -> Column:
    """Sample standard deviation, 0 for a single value."""
    return F.when(F.count(value) > 1, F.stddev_samp(value)).when(F.count(value) == 1, F.lit(0.0))


def whole_std(value: Column) -> Column:
    """Sample standard deviation of whole numbers as a whole number, halves to the even one, 0 for a single value.

    From exact sums, so that a spread of just k + 1/2 is one whatever the order of the rows is.
    """
    x = value.cast("decimal(18,0)")
    n, total = F.count(value), F.sum(x)
    squares = (F.sum(x * x) * n - total * total).cast("double")
    spread = F.bround(F.sqrt(F.try_divide(squares, n.cast("double") * (n - 1)))).cast("long")
    return F.when(n > 1, spread).when(n == 1, F.lit(0).cast("long"))


def plus_minus(mean: Column, std: Column, digits: int = 2) -> Column:
    """'mean+/-std', or N/A where either is missing."""
    return F.when(mean.isNull() | std.isNull(), "N/A").otherwise(F.format_string(f"%.{digits}f+/-%.{digits}f", mean, std))
