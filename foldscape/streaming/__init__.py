"""FASTA files as they arrive: each micro-batch of new files becomes sequences in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.fasta import _lines, _records, accepted, parse_records


def stream_fasta(spark: SparkSession, folder: str) -> DataFrame:
    """Streaming file, record, description, seq, length of accepted records of new *.fasta files in a folder."""
    return accepted(parse_records(_records(_lines(spark.readStream, folder, F.lit(0).cast("long"))).drop("ordinal")))


def sink_sequences(stream: DataFrame, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends the sequences to a Parquet table; restarted from its checkpoint, no file is taken twice."""
    writer = stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
