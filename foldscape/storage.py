"""Tables kept in the folder that all executors share."""

from __future__ import annotations

import tempfile
import time
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

_made: list[str] = []


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_foldscape_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="foldscape-")) / "foldscape_src.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    sc.addPyFile(str(target))
    sc._foldscape_shipped = True


def shared_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, one of our own in local mode; elsewhere an error,
    because the machines of a cluster don't see one another's folders."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="foldscape-shared-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI in the shared folder."""
    _made.append(f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


class measured:  # noqa: N801
    """Notes of the tables that are kept inside: (name, rows, seconds of the job that wrote it), the rows by the job itself."""

    def __init__(self):
        self.found: list[tuple[str, int, float]] = []

    def __enter__(self) -> measured:
        _measuring.append(self)
        return self

    def __exit__(self, *_) -> None:
        _measuring.remove(self)


_measuring: list[measured] = []


def kept(df: DataFrame, name: str) -> DataFrame:
    """Writes a DataFrame to the shared folder and reads it again: cuts lineage and outlives executors."""
    where = shared_folder(df.sparkSession, name)
    if _measuring:
        seen, began = Observation(), time.perf_counter()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(where)
        for m in _measuring:
            m.found.append((name, seen.get["rows"], time.perf_counter() - began))
    else:
        df.write.parquet(where)
    out = df.sparkSession.read.schema(df.schema).parquet(where)
    out._kept_in = where
    return out


def _delete(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def dropped(df: DataFrame) -> None:
    """Deletes what `kept` wrote for this DataFrame, which can't be used any more."""
    where = df._kept_in
    if where in _made:
        _made.remove(where)
        _delete(df.sparkSession, where)


def clear(spark: SparkSession) -> None:
    """Deletes all folders that this process has made; DataFrames that read them can't be used any more."""
    while _made:
        _delete(spark, _made.pop())


class scratch:  # noqa: N801
    """Deletes at its end the folders made inside, once nothing reads them any more, but those of DataFrames it is told to keep."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> scratch:
        self.before = set(_made)
        return self

    def keep(self, df: DataFrame) -> None:
        self.before.add(df._kept_in)

    def __exit__(self, *_) -> None:
        for where in [w for w in _made if w not in self.before]:
            _made.remove(where)
            _delete(self.spark, where)


def ranked(df: DataFrame, name: str, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Adds a column with the row's number from 0 in the order of some columns, which must tell the rows of a key apart.

    Rows are dealt into ranges of (keys, order), the rows of each key in each range are counted, and a key's numbers in a range
    begin where those of the ranges before end: no task has all rows of a key, nor has one range more than its share.
    """
    ranges = kept(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    ahead = Window.partitionBy(*keys).orderBy("_part") if keys else Window.orderBy("_part")  # over a row for each range that a key is in
    counts = ranges.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_count"))
    begin = counts.withColumn("_begin", F.coalesce(F.sum("_count").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("_part", *keys).orderBy(*order)
    placed = ranges.withColumn("_within", F.row_number().over(inside) - 1)
    ahead_of = begin.select(F.col("_part").alias("_in"), *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], "_begin")
    same = F.col("_part") == F.col("_in")
    for i, k in enumerate(keys):  # a null key is one like any other
        same &= F.col(k).eqNullSafe(F.col(f"_key{i}"))
    found = placed.join(ahead_of.hint("merge") if keys else F.broadcast(ahead_of), same).withColumn(name, (F.col("_within") + F.col("_begin")).cast("long"))  # keys may be as many as rows
    return found.drop("_part", "_begin", "_within", "_in", *[f"_key{i}" for i in range(len(keys))])


def numbered(df: DataFrame, name: str, order: Sequence[str]) -> DataFrame:
    """`ranked` over all rows."""
    return ranked(df, name, order)


def join_batch(df: DataFrame, of_batch: DataFrame, keys: list[str]) -> DataFrame:
    """Joins a row for each batch to its rows; without keys there is one batch and one such row."""
    return df.join(of_batch, keys) if keys else df.crossJoin(of_batch.limit(1))
