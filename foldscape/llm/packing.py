"""Order-preserving packing of tokenised documents into sequences of bounded length.

The tokens of a run of documents are one line; windows are cut from it without
changing the order.  A cut may stand at the end of a document (free), at the end of a
sentence (TRUNCATION_SENTENCE) or, only within stretches without either, at every
FORCED_STEP tokens (TRUNCATION_FORCED).  Dynamic programming over the possible cuts
minimises padding plus these penalties:

    f(j) = penalty(j) + min over i of f(i) + padding(pos_j - pos_i) + SEQUENCE_COST

For a window padded to W the inner minimum is of f(i) + pos_i over a sliding range of
i, kept in a monotone queue; a window whose length is a power of two has no padding
and is a direct transition from the cut that far back, where there is one.

Each partition packs its own documents in the order in which it reads them, in runs of
about RUN_TOKENS; the last OPEN windows of a run are cut anew with the next, so that only a
partition's end closes one early.  No shuffle, memory in proportion to one run,
one batch or one document, and a task that is run again gives the same rows.

Defined results: a null or empty text has the end id alone; repeated documents are
packed as often as they occur; a null id stays null; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import id_text, ship
from .encode import END_ID, encoder

WINDOW = 1024
RUN_TOKENS = 1 << 17
#: Windows at the end of a run that are left open.
OPEN = 4
TRUNCATION_SENTENCE = 1.0
TRUNCATION_FORCED = 8.0
FORCED_STEP = 32
FORCED_GAP = 64
SEQUENCE_COST = 256.0


def choose_cuts(pos: np.ndarray, penalty: np.ndarray, window: int = WINDOW, sequence_cost: float = SEQUENCE_COST) -> list[int]:
    """Indices into pos (ascending, no gap over window, first and last are always cuts) of the cheapest cuts."""
    m = len(pos)
    if m < 2:
        return [0] if m else []
    at = np.full(int(pos[-1]) + 1, -1, dtype=np.int64)
    at[pos] = np.arange(m)
    jumps: list[tuple[np.ndarray, np.ndarray]] = []
    step = 1
    while step < window:
        ok = np.flatnonzero(pos >= step)
        src = at[pos[ok] - step]
        jumps.append((ok[src >= 0], src[src >= 0]))
        step *= 2
    to = np.concatenate([a for a, _ in jumps])
    order = np.argsort(to, kind="stable")
    src = np.concatenate([b for _, b in jumps])[order].tolist()
    first = np.searchsorted(to[order], np.arange(m + 1)).tolist()
    p, pen = pos.tolist(), penalty.tolist()
    f, back = [0.0] * m, [0] * m
    queue: deque[tuple[float, int]] = deque([(float(p[0]), 0)])
    for j in range(1, m):
        here = p[j]
        low = here - window
        while p[queue[0][1]] < low:
            queue.popleft()
        best, i = queue[0]
        best += window - here
        for k in src[first[j] : first[j + 1]]:
            if f[k] < best:
                best, i = f[k], k
        best += pen[j] + sequence_cost
        f[j], back[j] = best, i
        key = best + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts, j = [m - 1], m - 1
    while j:
        j = back[j]
        cuts.append(j)
    return cuts[::-1]


def candidates(tokens: np.ndarray, ends: np.ndarray, sentence_end: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a cut may stand, and their penalties. ends: of documents, ascending, the last is len(tokens)."""
    penalty = np.full(len(tokens) + 1, np.inf)
    penalty[np.flatnonzero(sentence_end[tokens]) + 1] = TRUNCATION_SENTENCE
    penalty[ends] = 0
    penalty[0] = 0
    pos = np.flatnonzero(np.isfinite(penalty))
    gaps = np.diff(pos)
    for k in np.flatnonzero(gaps > min(FORCED_GAP, window)):
        more = np.arange(pos[k] + min(FORCED_STEP, window), pos[k + 1], min(FORCED_STEP, window))
        penalty[more] = TRUNCATION_FORCED
    pos = np.flatnonzero(np.isfinite(penalty))
    return pos, penalty[pos]


def sentence_table(tokenizer: str) -> np.ndarray:
    """For each id, whether its text closes a sentence or a line."""
    enc = encoder(tokenizer)
    out = np.zeros(enc.vocab_size, dtype=bool)
    for token, i in enc.tok.get_vocab(with_added_tokens=True).items():
        out[i] = token.rstrip("\"')").endswith((".", "!", "?")) or "Ċ" in token  # U+010A stands for a line feed
    out[END_ID] = True
    return out


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    ship(docs.sparkSession)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, closes = encoder(tokenizer), sentence_table(tokenizer)
        sequence = TaskContext.get().partitionId() << 32  # type: ignore[union-attr]
        # of the documents that are not packed yet: id (and whether it is null), tokens packed before, all tokens, those left
        keys, nulls, done, total, line = [], [], [], [], []
        held = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal sequence, held
            tokens = np.concatenate(line)
            sizes, before, whole = np.array([len(x) for x in line]), np.array(done), np.array(total)
            ends = np.cumsum(sizes)
            begins = ends - sizes
            pos, pen = candidates(tokens, ends, closes, window)
            cuts = pos[choose_cuts(pos, pen, window)]
            if not last:  # the cuts near the end would be others if more were known
                cuts = cuts[: max(2, len(cuts) - OPEN)]
            stop = int(cuts[-1])
            edges = np.unique(np.concatenate([cuts, begins[begins < stop], ends[ends < stop]]))
            a, z = edges[:-1], edges[1:]
            doc = np.searchsorted(ends, a, side="right")
            seq = np.searchsorted(cuts, a, side="right") - 1
            raw = tokens.astype("<u4")
            crc = [zlib.crc32(raw[x:y]) for x, y in zip(a.tolist(), z.tolist(), strict=True)]
            ids = pa.array(np.array(keys, dtype=np.int64)[doc], mask=np.array(nulls)[doc])
            if len(a):
                yield pa.RecordBatch.from_arrays([ids, pa.array(a - begins[doc] + before[doc]), pa.array(z - a), pa.array(crc, type=pa.int64()), pa.array(whole[doc]), pa.array(seq + sequence), pa.array(a - cuts[seq])], names)
            sequence += len(cuts) - 1
            first = int(np.searchsorted(ends, stop, side="right"))  # what the open window holds goes on
            for x in (keys, nulls, done, total, line):
                del x[:first]
            if line:
                into = stop - int(begins[first])
                done[0] += into
                line[0] = line[0][into:]
            held = len(tokens) - stop

        for b in batches:
            ids, off = enc.column(b.column("text"), end=True)
            at = off.tolist()
            for key, a, z in zip(b.column("doc_id").to_pylist(), at[:-1], at[1:], strict=True):
                keys.append(key or 0), nulls.append(key is None), done.append(0), total.append(z - a), line.append(ids[a:z])
                held += z - a
                if held >= max(RUN_TOKENS, 4 * OPEN * window):
                    yield from flush(False)
        if line:
            yield from flush(True)

    return id_text(docs, id_col, text_col).mapInArrow(run, schema)
