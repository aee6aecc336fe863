"""Byte-level BPE encoding of whole texts with a public tokenizer file.

The ids are always those of the ``tokenizers`` library.  Prose repeats its words, so a
text is cut into units, each distinct unit is encoded once for each Python worker, and
the text's ids are put together from the units.  Cutting, finding the distinct units and
putting together are done on whole columns.  That is exact: byte-level BPE never merges
across the pieces of its pre-tokenizer, and units are cut only where a piece ends
whatever stands around: between letters, digits, marks and white space of kinds that all
libraries agree on, before the last of white space, not beside other characters, nor
behind an apostrophe.  A text with the text of a special token is encoded directly.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import chunks, flat

#: The end-of-document id that every document gets.
END_ID = 0
#: Units kept for each worker (some 200 bytes each) and their characters; the table is emptied beyond either.
CACHE_UNITS = 600_000
CACHE_CHARS = 1 << 25
#: Bytes of text that are cut at once.
CHUNK_BYTES = 1 << 22
#: Units that are encoded together.
_JOINED = 200

#: Kinds of bytes; of two that follow one another, whether a unit ends between them.
_OTHER, _LETTER, _DIGIT, _BLANK, _MARK, _APOSTROPHE, _LINE = range(7)
_KIND = np.full(256, _OTHER, dtype=np.uint8)
_KIND[33:127] = _MARK
for _a, _z in (("A", "Z"), ("a", "z")):
    _KIND[ord(_a) : ord(_z) + 1] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[32], _KIND[39] = _BLANK, _APOSTROPHE
_KIND[[9, 10, 13]] = _LINE
_SOLID = (_LETTER, _DIGIT, _MARK, _APOSTROPHE)
_ENDS = np.zeros(64, dtype=bool)
for _x in _SOLID:
    for _y in _SOLID:
        _ENDS[_x * 8 + _y] = _x != _y and {_x, _y} != {_MARK, _APOSTROPHE} and (_x, _y) != (_APOSTROPHE, _LETTER)
    _ENDS[[_x * 8 + _BLANK, _x * 8 + _LINE, _LINE * 8 + _x]] = True


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the units of the texts data[offsets[i]:offsets[i+1]] begin."""
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)  # U+00C0 to U+00FF, letters but for two
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[1:-1] = _ENDS[kind[:-1] * np.uint8(8) + kind[1:]]
    starts = np.zeros(len(data) + 1, dtype=bool)
    starts[offsets] = True
    # the last of white space ahead of something solid is a piece's own beginning; where it stands behind what may be white space, all is one unit
    white = (kind == _BLANK) | (kind == _LINE)
    last = 1 + np.flatnonzero(white[1:-1] & ((kind[:-2] == _OTHER) | white[:-2]))
    last = last[np.isin(kind[last + 1], _SOLID) & ~starts[last] & ~starts[last + 1]]
    begins[last[white[last - 1]]] = True
    begins[last[kind[last - 1] == _OTHER] + 1] = False
    return np.flatnonzero((begins | starts)[:-1])


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts as unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.vocab_size = self.tok.get_vocab_size()
        self.tok.model._resize_cache(0)
        self.special = "|".join(re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values())
        # Byte length of each id: in byte-level BPE each character of a token stands for a byte.
        self.width = np.zeros(self.vocab_size, dtype=np.int64)
        for token, i in self.tok.get_vocab(with_added_tokens=False).items():
            self.width[i] = len(token)
        self._reset()

    def _reset(self) -> None:
        """Unit 0 is the end id."""
        self.index: dict[str, int] = {}
        self.new: list[str] = []
        self.chars = 0
        self.pool = np.zeros(1 << 16, dtype=np.uint32)
        self.pool[0] = END_ID
        self.used = 1
        self.off = np.zeros(1 << 14, dtype=np.int64)
        self.len = np.zeros(1 << 14, dtype=np.int64)
        self.len[0] = 1

    def _numbers(self, units: list[str]) -> np.ndarray:
        """The number of each of some distinct units; new ones are noted."""
        out = list(map(self.index.get, units))
        if None in out:
            for i, n in enumerate(out):
                if n is None:
                    out[i] = self.index[units[i]] = len(self.index) + 1
                    self.new.append(units[i])
                    self.chars += len(units[i])
        return np.array(out, dtype=np.int64)

    def _add(self, at: np.ndarray, ids: np.ndarray, lens: np.ndarray) -> None:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.off[at] = self.used + np.cumsum(lens) - lens
        self.len[at] = lens
        self.used += len(ids)

    def _direct(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self) -> None:
        """Encodes the units that have a number but no ids yet, many at once where they can't run into one another."""
        first = len(self.index) - len(self.new) + 1
        while len(self.index) >= len(self.off):
            self.off = np.concatenate([self.off, np.zeros_like(self.off)])
            self.len = np.concatenate([self.len, np.zeros_like(self.len)])
        solid = lambda c: "!" <= c <= "~"
        how = np.fromiter((0 if w[0] == " " and len(w) > 1 and solid(w[1]) else 1 if solid(w[0]) and solid(w[-1]) else 2 for w in self.new), dtype=np.int8, count=len(self.new))
        for between in (0, 1):  # nothing, or a line feed
            group = np.flatnonzero(how == between)
            for i in range(0, len(group), _JOINED):
                part = [self.new[k] for k in group[i : i + _JOINED].tolist()]
                ids = self._direct([("\n" * between).join(part)])[0]
                ends = np.cumsum([(len(w) if w.isascii() else len(w.encode())) + between for w in part]) - between
                stops = np.searchsorted(np.cumsum(self.width[ids]), ends) + 1
                lens = np.diff(stops, prepend=0)
                if between:
                    ids = np.delete(ids, stops[:-1])
                    lens[1:] -= 1
                self._add(group[i : i + _JOINED] + first, ids, lens)
        alone = np.flatnonzero(how == 2)
        for i in range(0, len(alone), _JOINED):
            at = alone[i : i + _JOINED]
            got = self._direct([self.new[k] for k in at.tolist()])
            self._add(at + first, np.concatenate(got), np.array([len(g) for g in got]))
        self.new.clear()

    def column(self, texts: pa.Array, end: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, n+1 offsets); null is empty; with end, END_ID follows each text.

        Work and memory are in proportion to the texts."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        odd = np.flatnonzero(pc.match_substring_regex(texts, self.special).fill_null(False).to_numpy(zero_copy_only=False)) if self.special else []
        data, offsets = flat(texts)
        for i, j in chunks(offsets, CHUNK_BYTES):
            x, n = self._part(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], end)
            own = [int(k) - i for k in odd if i <= k < j]
            if own:
                done = np.split(x, np.cumsum(n)[:-1])
                for k, y in zip(own, self._direct(texts.take(pa.array([i + k for k in own])).to_pylist()), strict=True):
                    done[k] = np.append(y, np.uint32(END_ID)) if end else y
                    n[k] = len(done[k])
                x = np.concatenate(done)
            ids.append(x)
            sizes.append(n)
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)

    def _part(self, data: np.ndarray, offsets: np.ndarray, end: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each text)."""
        if len(self.index) > CACHE_UNITS or self.chars > CACHE_CHARS:
            self._reset()
        starts = cuts(data, offsets)
        at = np.append(starts, len(data)).astype(np.int32 if len(data) < 1 << 31 else np.int64)
        kind = pa.StringArray if at.dtype == np.int32 else pa.LargeStringArray
        units = kind.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        unit = self._numbers(units.dictionary.to_numpy(zero_copy_only=False).tolist())[units.indices.to_numpy()] if len(starts) else np.zeros(0, np.int64)
        if self.new:
            self._learn()
        first = np.searchsorted(starts, offsets)
        if end:  # unit 0 behind each text
            unit = np.insert(unit, first[1:], 0)
            first = first + np.arange(len(first))
        lens = self.len[unit]
        stops = np.concatenate([[0], np.cumsum(lens)])
        out = self.pool[np.repeat(self.off[unit] - stops[:-1], lens) + np.arange(stops[-1])]
        return out, np.diff(stops[first])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        ids, off = self.column(pa.array(texts, type=pa.large_string()))
        return [ids[a:z] for a, z in zip(off[:-1], off[1:], strict=True)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each tokenizer file and Python process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
