"""Runs of bytes of a given class in many texts at once, as positions in flat arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .words import LOWER

_BYTES = np.arange(256)
#: Letters: a-z, A-Z and all bytes of characters beyond ASCII.
LETTERS = ((LOWER >= 97) & (LOWER <= 122)) | (_BYTES >= 128)
#: All but white space: space, and tab to carriage return.
SOLID = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))


def runs(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all runs end to end with A-Z lower-cased, size of each run, its text, and each text's first run) of the
    texts data[offsets[i]:offsets[i+1]]; offsets begin at 0. A run ends with its text."""
    inside = kind[data]
    n = len(data)
    step = np.zeros(n, dtype=bool)  # where a run begins
    if n:
        step[0] = inside[0]
        np.logical_and(inside[1:], ~inside[:-1], out=step[1:])
        begins = offsets[:-1][np.diff(offsets) > 0]
        step[begins] = inside[begins]
    starts = np.flatnonzero(step)
    before = np.cumsum(inside, dtype=np.int64)[starts] if n else starts  # bytes of runs up to a run's first byte
    total = int(inside.sum())
    sizes = np.diff(np.append(before - 1, total)) if len(starts) else np.zeros(0, dtype=np.int64)
    first = np.searchsorted(starts, offsets)
    return LOWER[data[inside]], sizes, np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first


def as_strings(letters: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The runs as an array of strings."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(letters)))
