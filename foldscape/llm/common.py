"""What the operators of this subpackage share: files that all executors see and
columns as flat bytes."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import kept, shared_folder, ship  # noqa: F401

#: Bytes of text that are worked on at once; a longer text is a piece of its own.
CHUNK_BYTES = 1 << 20


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a URI or plain path."""
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        if urlsplit(uri).scheme == "file":
            return fs.LocalFileSystem(), urlsplit(uri).path
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def write_bytes(uri: str, parts: Iterable[bytes]) -> None:
    """Writes a file whole: under another name first, so that a lost task leaves no half of it."""
    where, path = filesystem(uri)
    temp = f"{path}.{uuid.uuid4().hex}.tmp"
    where.create_dir(os.path.dirname(path), recursive=True)
    with where.open_output_stream(temp) as out:
        for p in parts:
            out.write(p)
    where.move(temp, path)


def map_array(uri: str, dtype) -> np.ndarray:
    """A file of numbers, memory-mapped where it is in a local file system, else read."""
    from pyarrow import fs

    where, path = filesystem(uri)
    if where.get_file_info(path).size == 0:
        return np.zeros(0, dtype=dtype)
    if isinstance(where, fs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r")
    with where.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=dtype)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n+1 offsets) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows with about `size` bytes of text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id as a long and the text, null as empty, under fixed names."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def add_from_text(docs: DataFrame, work, schema: str, text_col: str = "text") -> DataFrame:
    """Adds columns made from the text, one task's rows at a time; no shuffle.

    work takes an iterator of string arrays and yields, for each of them in order, a list of
    arrays of the same length in the order of schema; it may read ahead. All other columns
    pass through whatever they are named; an added column takes the place of one with its name.
    """
    ship(docs.sparkSession)
    kept_names = docs.columns
    added = [f.name for f in docs.sparkSession.createDataFrame([], schema).schema]
    numbered = docs.toDF(*[f"c{i}" for i in range(len(kept_names))])
    text_at = kept_names.index(text_col)
    new = docs.sparkSession.createDataFrame([], schema).toDF(*[f"n{i}" for i in range(len(added))])
    full = numbered.schema.__class__([*numbered.schema.fields, *new.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def texts() -> Iterator[pa.Array]:
            for b in batches:
                waiting.append(b)
                yield b.column(text_at)

        for columns in work(texts()):
            b = waiting.pop(0)
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], [f.name for f in full])

    out = numbered.mapInArrow(run, full)
    old = [F.col(f"c{i}").alias(n) for i, n in enumerate(kept_names) if n not in added]
    return out.select(*old, *[F.col(f"n{i}").alias(n) for i, n in enumerate(added)])
