"""Words of many texts at once, as positions and 64-bit hashes in flat arrays.

A word is a run of bytes in 0-9, a-z (A-Z lower-cased) and 0x80-0xFF: on UTF-8 the
same as a run of characters ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing
A-Z alone.  Hashes depend on the word's bytes only, on any machine.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
IS_WORD = ((LOWER >= 48) & (LOWER <= 57)) | ((LOWER >= 97) & (LOWER <= 122)) | (_BYTES >= 128)
#: A random 64-bit value for each of the first _PLACES places of a word and each byte.
_PLACES = 64
_VALUES = np.random.default_rng(20240503).integers(0, 1 << 64, _PLACES * 256, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


@dataclass
class Words:
    """Of texts laid end to end: each word's first byte and end, its hash, and the first word of each text."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray, hashed: bool = True) -> Words:
    """The words of the texts data[offsets[i]:offsets[i+1]]; offsets begin at 0."""
    low = LOWER[data]
    inside = IS_WORD[data]
    n = len(data)
    begins = np.zeros(n + 1, dtype=bool)
    begins[offsets] = True
    before = np.empty(n, dtype=bool)
    after = np.empty(n, dtype=bool)
    if n:
        before[0], after[-1] = False, False
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        before &= ~begins[:-1]
        after &= ~begins[1:]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    hashes = _hash(low[inside], ends - starts) if hashed else np.zeros(0, dtype=np.uint64)
    return Words(starts, ends, hashes, np.searchsorted(starts, offsets))


def _hash(letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of words laid end to end, each of some letters: sums of the values of their places and bytes."""
    if not len(sizes):
        return np.zeros(0, dtype=np.uint64)
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(letters)) - np.repeat(first, sizes)
    value = _VALUES[((place & (_PLACES - 1)) << 8) | letters]
    far = np.flatnonzero(place >= _PLACES)
    value[far] = mix(value[far] + (place[far] // _PLACES).astype(np.uint64))
    return mix(np.add.reduceat(value, first) + sizes.astype(np.uint64))


def hash_word(word: bytes) -> int:
    """The hash that `words` gives this word."""
    w = words(np.frombuffer(word, dtype=np.uint8), np.array([0, len(word)]))
    return int(w.hashes[0])


def word_list(text: str) -> list[bytes]:
    """The words of one text, lower-cased."""
    return text.encode().translate(_TABLE).split()


_TABLE = bytes(int(b) if k else 32 for b, k in zip(LOWER, IS_WORD, strict=True))


class Vocabulary:
    """Ids 1.. of some words (as `word_list` gives them), 0 for others: a bit table of hashes first, then binary search, then the words' bytes themselves."""

    def __init__(self, known: Iterable[bytes]):
        names = sorted(set(known))
        joined = np.frombuffer(b" ".join(names), dtype=np.uint8)
        distinct = sorted(zip(words(joined, np.array([0, len(joined)])).hashes.tolist(), names, strict=True))
        self.number = {w: i + 1 for i, (_, w) in enumerate(distinct)}
        self.hashes = np.array([h for h, _ in distinct], dtype=np.uint64)
        self.letters = np.frombuffer(b"".join(w for _, w in distinct), dtype=np.uint8)
        self.ends = np.cumsum([len(w) for _, w in distinct]).astype(np.int64)
        self.starts = self.ends - np.array([len(w) for _, w in distinct], dtype=np.int64)
        bits = max(12, min(24, int(len(self.hashes) * 16).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.maybe = np.zeros(1 << bits, dtype=bool)
        self.maybe[self.hashes >> self.shift] = True

    def __len__(self) -> int:
        return len(self.hashes)

    def ids(self, w: Words, data: np.ndarray) -> np.ndarray:
        """The id of each word of `words(data, ...)`."""
        out = np.zeros(len(w.hashes), dtype=np.int64)
        if not len(self):
            return out
        at = np.flatnonzero(self.maybe[w.hashes >> self.shift])
        k = np.searchsorted(self.hashes, w.hashes[at])
        while len(at):  # again only where words share a hash
            ok = k < len(self)
            at, k = at[ok], k[ok]
            ok = self.hashes[k] == w.hashes[at]
            at, k = at[ok], k[ok]
            same = self._same(data, w.starts[at], w.ends[at], k)
            out[at[same]] = k[same] + 1
            at, k = at[~same], k[~same] + 1
        return out

    def _same(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Whether data[starts:ends], lower-cased, is word k."""
        size = ends - starts
        out = size == self.ends[k] - self.starts[k]
        some = np.flatnonzero(out)
        size = size[some]
        if len(some):
            first = np.cumsum(size) - size
            step = np.arange(size.sum()) - np.repeat(first, size)
            equal = LOWER[data[np.repeat(starts[some], size) + step]] == self.letters[np.repeat(self.starts[k[some]], size) + step]
            out[some] = np.logical_and.reduceat(equal, first)
        return out


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first shingle of each text) of n consecutive words; a text of fewer words, but not none, has one of all its words."""
    counts = np.diff(w.first)
    total = len(w.hashes)
    fold = np.zeros(total, dtype=np.uint64)
    for k in range(n):  # a word beyond the text's end counts as 0
        at = np.arange(total) + k
        stop = np.repeat(w.first[1:], counts)
        ok = at < stop
        fold = fold * np.uint64(0x9FB21C651E98DF25) + np.uint64(0x632BE59BD9B4E019)
        fold[ok] ^= w.hashes[np.minimum(at, max(total - 1, 0))[ok]]
        fold = mix(fold)
    number = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    keep = np.arange(total) - np.repeat(w.first[:-1], counts) < np.repeat(number, counts)
    return fold[keep], np.concatenate([[0], np.cumsum(number)])
