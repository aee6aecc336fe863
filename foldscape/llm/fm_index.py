"""An FM-index over a collection of symbol strings, in numpy.

The collection is one array in which 0 ends each string; other symbols are 1 and more.
Suffixes are sorted by prefix doubling, ends of strings differing by their places.  The
Burrows-Wheeler transform is held in a wavelet matrix with a count of ones for every
place and bit level; suffix positions are sampled at every `sample`-th place and at the
first of each string, so that no walk passes a string's end.  All queries take arrays.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes; text ends with 0, and suffixes end at their string's end."""
    n = len(text)
    ends = text == 0
    z = int(ends.sum())
    rank = text.astype(np.int64) + z - 1
    rank[ends] = np.arange(z)
    step = 1
    while True:
        second = np.zeros(n, dtype=np.int64)
        second[: n - step] = rank[step:] + 1
        second[ends] = 0
        key = rank * (max(int(rank.max()), int(second.max())) + 1) + second
        order = np.argsort(key)
        new = np.empty(n, dtype=np.int64)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) > 0)])
        rank = new
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class Patterns:
    """Patterns of symbols 1 and more, back to front in a table that is filled up with 0."""

    def __init__(self, patterns: list[np.ndarray]):
        self.lengths = np.array([len(p) for p in patterns], dtype=np.int64)
        self.table = np.zeros((len(patterns), int(self.lengths.max(initial=0))), dtype=np.int64)
        for i, p in enumerate(patterns):
            self.table[i, : len(p)] = p[::-1]


class FMIndex:
    def __init__(self, text: np.ndarray, sample: int = 16):
        n = len(text)
        order = suffix_array(text)
        last = text[order - 1]  # of place 0 the text's last symbol, an end
        self.n, self.sigma = n, int(text.max(initial=0)) + 1
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.sigma))])
        self.levels: list[tuple[int, np.ndarray, int]] = []
        column = last.astype(np.int64)
        for bit in reversed(range(max(1, (self.sigma - 1).bit_length()))):
            ones = (column >> bit) & 1
            count = np.concatenate([[0], np.cumsum(ones)]).astype(np.int64)
            self.levels.append((bit, count, n - int(count[-1])))
            column = np.concatenate([column[ones == 0], column[ones == 1]])
        self.last = last
        first = np.concatenate([[True], text[:-1] == 0]) if n else np.zeros(0, bool)
        sampled = (order % sample == 0) | first[order]
        self.sampled = sampled
        self.number = np.cumsum(sampled) - 1
        self.places = order[sampled]

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol stands among the first rows of the transform."""
        low = np.zeros_like(row)
        for bit, count, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            a, b = count[low], count[row]
            low = np.where(one, zeros + a, low - a)
            row = np.where(one, zeros + b, row - b)
        return row - low

    def search(self, patterns: Patterns) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of many patterns at once: the rows [low, high) of each; those with a symbol that the text lacks are passed over."""
        there = np.append(np.diff(self.before) > 0, False)
        there[0] = True  # what fills up the shorter ones
        all_there = np.ones(len(patterns.lengths), dtype=bool)
        for k in range(patterns.table.shape[1]):
            live = np.flatnonzero(all_there)
            all_there[live] = there[np.minimum(patterns.table[live, k], self.sigma)]
        low, high = np.zeros(len(all_there), dtype=np.int64), np.where(all_there & (patterns.lengths > 0), self.n, 0)
        for k in range(patterns.table.shape[1]):
            live = np.flatnonzero((k < patterns.lengths) & (low < high))
            if not len(live):
                break
            c = patterns.table[live, k]
            low[live] = self.before[c] + self.rank(c, low[live])
            high[live] = self.before[c] + self.rank(c, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places in the text of suffixes, by walking back to sampled ones."""
        rows = rows.copy()
        steps = np.zeros(len(rows), dtype=np.int64)
        live = np.flatnonzero(~self.sampled[rows])
        while len(live):
            c = self.last[rows[live]]
            rows[live] = self.before[c] + self.rank(c, rows[live])
            steps[live] += 1
            live = live[~self.sampled[rows[live]]]
        return self.places[self.number[rows]] + steps
