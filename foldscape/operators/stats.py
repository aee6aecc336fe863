"""Means, spreads and empirical p-values over runs and null samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import half_even, sample_std
from ..storage import join_batch


def mean_std(samples: DataFrame, values: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """keys, n, mean_x and std_x (sample, 0 for one value) of each value x; without keys one row for all."""
    parts = [c for v in values for c in (F.avg(v).alias(f"mean_{v}"), sample_std(F.col(v)).alias(f"std_{v}"))]
    return samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *parts)


def rounded_means(samples: DataFrame, values: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """keys and the means of each value as whole numbers, halves to the even one."""
    return samples.groupBy(*keys).agg(*[half_even(F.avg(v)).alias(v) for v in values])


def two_sided_p(samples: DataFrame, real: DataFrame, keys: Sequence[str], value: str = "u_nt") -> DataFrame:
    """keys, n, p_value: the share of samples at least as far from their mean as the real value is.

    samples: keys, value; real: keys, real_value. Means are joined back, so a large batch stays distributed.
    """
    means = samples.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    far = F.abs(F.col(value) - F.col("_mean")) >= F.abs(F.col("real_value") - F.col("_mean"))
    return join_batch(join_batch(samples, means, list(keys)), real, list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(far.cast("double")).alias("p_value"))


def ensemble_row(summaries: DataFrame, values: Sequence[str]) -> DataFrame:
    """One row: mean and spread over sequences; a single sequence has spread 0."""
    return mean_std(summaries, values, [])
