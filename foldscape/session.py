"""Settings for sessions that run the analysis."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: One thread in each task's linear algebra; plans that adapt to sizes and skew.
SETTINGS = {
    "spark.executorEnv.OMP_NUM_THREADS": "1",
    "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
    "spark.executorEnv.MKL_NUM_THREADS": "1",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.python.worker.reuse": "true",
}


def build(name: str = "foldscape", **more: str) -> SparkSession:
    """A session with these settings; more settings by name, with _ for the dots."""
    builder = SparkSession.builder.appName(name).config(map=SETTINGS)
    for k, v in more.items():
        builder = builder.config(k.replace("_", "."), v)
    return builder.getOrCreate()
