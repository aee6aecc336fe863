"""Token ids as flat unsigned-integer files with 64-bit document offsets.

A shard is three files beside one another: ``NNNNN.bin`` with the ids of its
documents laid end to end (unsigned 16-bit where the vocabulary allows, else 32-bit,
little-endian), ``NNNNN.off`` with n+1 signed 64-bit offsets in ids, and ``NNNNN.ids``
with the n document ids.  Documents stand in ascending id order over all shards.
``manifest.json`` lists the shards with their null ids (which come first) and bases: prefix sums of their documents
and ids, so that any document's place in the whole is base + offset.

Defined results: a null or empty text is one end id; repeated ids are kept, in the
order of a hash of their texts; a null id comes first; an empty table gives a manifest
without shards.  A very long text is cut into units and put together whole.  Other columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, id_text, map_array, shared_folder, ship, write_bytes
from .encode import END_ID, encoder

#: Documents that are encoded at once.
ROWS = 2000


@dataclass
class TokenFiles:
    """The shards of a folder. Each: name, documents, null document ids, ids, first document and first id in the whole."""

    folder: str
    dtype: str
    shards: list[dict]

    @classmethod
    def open(cls, folder: str) -> TokenFiles:
        where, path = filesystem(f"{folder}/manifest.json")
        with where.open_input_file(path) as f:
            x = json.loads(f.read())
        return cls(folder, x["dtype"], x["shards"])

    def save(self) -> None:
        write_bytes(f"{self.folder}/manifest.json", [json.dumps({"dtype": self.dtype, "shards": self.shards}).encode()])

    def shard(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, offsets, document ids) of a shard, memory-mapped."""
        at = f"{self.folder}/{self.shards[k]['name']}"
        return map_array(at + ".bin", self.dtype), map_array(at + ".off", "<i8"), map_array(at + ".ids", "<i8")

    def tokens(self, start: int, length: int) -> np.ndarray:
        """Ids start .. start+length of the whole, across shards."""
        got = []
        for k, s in enumerate(self.shards):
            a, b = max(start, s["base"]), min(start + length, s["base"] + s["n_tokens"])
            if a < b:
                got.append(self.shard(k)[0][a - s["base"] : b - s["base"]])
        return np.concatenate(got) if got else np.zeros(0, dtype=self.dtype)


def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> TokenFiles:
    """Encodes every whole text, appends END_ID to each, and writes the shards; the driver gets one row for each shard."""
    spark = docs.sparkSession
    ship(spark)
    folder = folder or shared_folder(spark, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        kind = "<u2" if enc.vocab_size <= 1 << 16 else "<u4"
        name = f"{TaskContext.get().partitionId():05d}"  # type: ignore[union-attr]
        lengths, ids, nulls = [], [], 0

        def data(first: pa.RecordBatch) -> Iterator[bytes]:
            nonlocal nulls
            for b in itertools.chain([first], batches):
                for i in range(0, b.num_rows, ROWS):
                    part = b.slice(i, ROWS)
                    x, off = enc.column(part.column("text"), end=True)
                    nulls += part.column("doc_id").null_count
                    ids.append(part.column("doc_id").fill_null(0).to_numpy().astype("<i8"))
                    lengths.append(np.diff(off))
                    yield x.astype(kind).tobytes()

        first = next((b for b in batches if b.num_rows), None)
        if first is not None:
            write_bytes(f"{folder}/{name}.bin", data(first))
            sizes = np.concatenate(lengths)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("<i8")
            write_bytes(f"{folder}/{name}.off", [offsets.tobytes()])
            write_bytes(f"{folder}/{name}.ids", [x.tobytes() for x in ids])
            yield pa.RecordBatch.from_pydict({"name": [name], "n_docs": [len(sizes)], "n_null": [nulls], "n_tokens": [int(offsets[-1])], "dtype": [kind]})

    rows = (
        id_text(docs, id_col, text_col)
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
        .mapInArrow(write, "name string, n_docs long, n_null long, n_tokens long, dtype string")
        .collect()
    )
    shards, base, doc_base = [], 0, 0
    for r in sorted(rows, key=lambda r: int(r.name)):
        shards.append({"name": r.name, "n_docs": r.n_docs, "n_null": r.n_null, "n_tokens": r.n_tokens, "base": base, "doc_base": doc_base})
        base, doc_base = base + r.n_tokens, doc_base + r.n_docs
    out = TokenFiles(folder, rows[0].dtype if rows else "<u4", shards)
    out.save()
    return out


def read_token_files(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """One row for each document, from the files alone: doc_id, start, n_tokens, and the crc32 of its ids as little-endian 32-bit integers."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files.shards:
        return spark.createDataFrame([], schema)
    ship(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column("id").to_pylist():
                data, offsets, ids = files.shard(k)
                for i in range(0, len(ids), 5000):
                    off = offsets[i : i + 5001]
                    crc = [zlib.crc32(data[a:z].astype("<u4")) for a, z in zip(off[:-1], off[1:], strict=True)]
                    key = ids[i : i + 5000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key, mask=np.arange(i, i + len(key)) < files.shards[k]["n_null"]), pa.array(off[:-1] + files.shards[k]["base"]), pa.array(np.diff(off)), pa.array(crc, type=pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    n = len(files.shards)
    return spark.range(0, n, 1, n).mapInArrow(read, schema)
