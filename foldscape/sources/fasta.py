"""FASTA files as a table of sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize_sequence
from ..storage import kept, numbered, ship

MIN_LENGTH = 10


def read_fasta(spark: SparkSession, folder: str) -> DataFrame:
    """file, ordinal, record of every record in the folder's *.fasta files (not below it).

    Records are split by the reader itself, so a large file is read by many tasks; ordinal only orders records of one file.
    What stands ahead of a file's first > is no record. A file that can't be read gives no rows; `unreadable` names it.
    """
    return _records(_lines(spark.read.option("ignoreCorruptFiles", "true"), folder, F.monotonically_increasing_id()))


def _lines(reader, folder: str, ordinal: Column) -> DataFrame:
    rows = reader.option("lineSep", "\n>").option("pathGlobFilter", "*.fasta").text(folder)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), ordinal.alias("ordinal"), F.regexp_replace("value", "\r", "").alias("record"))


def _records(lines: DataFrame) -> DataFrame:
    """Only a file's first row has its > still, or is what stands ahead of one: the first row that a task reads of block 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for b in batches:
            file, block, record = (b.column(c) for c in ("file", "block", "record"))
            first = np.zeros(b.num_rows, dtype=bool)
            at = [(f, k) for f, k in zip(file.to_pylist(), block.to_pylist(), strict=True)]
            for i, x in enumerate(at):
                first[i] = x != before and x[1] == 0
                before = x
            marked = pc.starts_with(record, ">").to_numpy(zero_copy_only=False)
            body = pc.if_else(pa.array(first & marked), pc.utf8_slice_codeunits(record, 1), record)
            out = pa.RecordBatch.from_arrays([file, b.column("ordinal"), body], ["file", "ordinal", "record"])
            yield out.filter(pa.array(~first | marked))

    ship(lines.sparkSession)
    return lines.mapInArrow(run, "file string, ordinal long, record string")


def unreadable(spark: SparkSession, folder: str, records: DataFrame) -> DataFrame:
    """file and reason of the folder's files that gave no record."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.fasta").load(folder).select(F.col("_metadata.file_path").alias("file"))
    return listed.join(records.select("file").distinct(), "file", "left_anti").withColumn("reason", F.lit("no record could be read"))


def load_folder(spark: SparkSession, folder: str, least: int = MIN_LENGTH) -> tuple[DataFrame, DataFrame]:
    """(seq_id, file, description, seq, length of accepted sequences, numbered from the shortest; file, description, reason of what was left out)."""
    parsed = kept(parse_records(read_fasta(spark, folder)), "fasta")
    good = numbered(accepted(parsed, least), "seq_id", ["length", "file", "ordinal"]).select("seq_id", "file", "description", "seq", "length")
    bad = rejected(parsed, least).select("file", "description", "reason")
    return good, bad.unionByName(unreadable(spark, folder, parsed), allowMissingColumns=True)


def split_fasta(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, ordinal, record of the records in texts that hold whole files; what stands before the first > is no record."""
    parts = F.split(F.regexp_replace(F.col(text), "\r", ""), "(^|\n)>")
    return texts.select(F.col(key), F.posexplode(parts).alias("ordinal", "record")).where("ordinal > 0")


def parse_records(records: DataFrame) -> DataFrame:
    """Adds description (the header line), seq (normalised) and length; drops record."""
    header = F.trim(F.regexp_extract("record", "^([^\n]*)", 1))
    body = F.regexp_replace("record", "^[^\n]*\n?", "")
    out = records.withColumns({"description": header, "seq": normalize_sequence(body)})
    return out.withColumn("length", F.length("seq")).drop("record")


def accepted(sequences: DataFrame, least: int = MIN_LENGTH) -> DataFrame:
    """Sequences long enough."""
    return sequences.where(F.col("length") >= least)


def rejected(sequences: DataFrame, least: int = MIN_LENGTH) -> DataFrame:
    """The others, with the reason."""
    why = F.when(F.col("length").isNull(), "no sequence").when(F.col("length") == 0, "no letters of the alphabet").otherwise(F.lit(f"shorter than {least}"))
    return sequences.where(F.coalesce(F.col("length") < least, F.lit(True))).withColumn("reason", why)


def by_length(sequences: DataFrame, *ties: str) -> DataFrame:
    """Shortest first; ties by the given columns."""
    return sequences.orderBy("length", *ties)


def literal_sequence(spark: SparkSession, seq: str, description: str = "literal") -> DataFrame:
    """One sequence, normalised like any other."""
    one = spark.createDataFrame([(0, description, seq)], "seq_id long, description string, seq string")
    return one.withColumn("seq", normalize_sequence(F.col("seq"))).withColumn("length", F.length("seq"))
