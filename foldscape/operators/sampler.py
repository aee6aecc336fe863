"""Boltzmann sampling of secondary structures without an outside library.

A partition function over nested structures (McCaskill 1990) with stacking, hairpin, bulge,
interior and multi-branch loop energies, and stochastic traceback.  Energies are those of a
compact nearest-neighbour model from published tables, not those of any particular package;
structures with energies from elsewhere enter the analysis as a table instead.  Sequences
and runs are rows: one grouped call for each, seeded by the run.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import COMPLEMENTARY
from ..params import Params
from ..storage import ship

# Published nearest-neighbour energies at 37 degrees in kcal/mol (Xia et al. 1998; Mathews et al. 1999, rounded).
#: Pair, then the pair inside it, both read 5' to 3'.
STACK = {
    "AUAU": -0.93, "AUUA": -1.10, "UAAU": -1.33, "CGUA": -2.08, "CGAU": -2.11, "GCUA": -2.24, "GCAU": -2.35,
    "CGGC": -2.36, "GCGC": -3.26, "GCCG": -3.42,
}
WOBBLE_STACK = -1.2
HAIRPIN = {3: 5.4, 4: 5.6, 5: 5.7, 6: 5.4, 7: 6.0, 8: 5.5, 9: 6.4}
BULGE = {1: 3.8, 2: 2.8, 3: 3.2, 4: 3.6, 5: 4.0, 6: 4.4}
INTERIOR = {2: 0.5, 3: 1.6, 4: 1.1, 5: 2.0, 6: 2.0}
ASYMMETRY, WEAK_END, MULTI_CLOSE, MULTI_BRANCH, LOOP_MOST = 0.6, 0.5, 3.4, 0.4, 30
_LOG = 1.08  # kcal/mol for each e-fold of loop length beyond the tables

_FEW = 8  # so many draws are parted one by one


def _long(table: dict[int, float], n: int) -> float:
    most = max(table)
    return table[n] if n in table else table[min(table)] if n < min(table) else table[most] + _LOG * math.log(n / most)


def _weak(seq: str, i: int, j: int) -> float:
    return WEAK_END if seq[i] + seq[j] not in ("GC", "CG") else 0.0


def _stack(outer: str, inner: str) -> float:
    turned = inner[::-1] + outer[::-1]
    return STACK.get(outer + inner, STACK.get(turned, WOBBLE_STACK))


def loop_energy(seq: str, i: int, j: int, k: int, m: int) -> float:
    """Of the loop closed by (i, j) outside and (k, m) inside."""
    left, right = k - i - 1, j - m - 1
    if left == right == 0:
        return _stack(seq[i] + seq[j], seq[k] + seq[m])
    if left == 0 or right == 0:
        n = left + right
        inside = _stack(seq[i] + seq[j], seq[k] + seq[m]) if n == 1 else _weak(seq, i, j) + _weak(seq, k, m)
        return _long(BULGE, n) + inside
    return _long(INTERIOR, left + right) + min(3.0, ASYMMETRY * abs(left - right)) + _weak(seq, i, j) + _weak(seq, k, m)


def structure_energy(seq: str, structure: str) -> float:
    """Energy of a dot-bracket structure."""
    stack: list[int] = []
    inside: dict[int, list[tuple[int, int]]] = {-1: []}
    total = 0.0
    for j, c in enumerate(structure):
        if c == "(":
            stack.append(j)
            inside[j] = []
        elif c == ")":
            i = stack.pop()
            parts = inside.pop(i)
            if not parts:
                total += _long(HAIRPIN, j - i - 1) + (_weak(seq, i, j) if j - i - 1 == 3 else 0.0)
            elif len(parts) == 1:
                total += loop_energy(seq, i, j, *parts[0])
            else:
                total += MULTI_CLOSE + MULTI_BRANCH * (len(parts) + 1) + _weak(seq, i, j) + sum(_weak(seq, *x) for x in parts)
            inside[stack[-1] if stack else -1].append((i, j))
    return total + sum(_weak(seq, *x) for x in inside[-1])


class Fold:
    """Tables of log weights of the parts of a sequence; `best` keeps the heaviest instead of the sum, for the least energy."""

    def __init__(self, seq: str, rt: float, min_hairpin: int = 3, best: bool = False):
        self.seq, self.rt, self.gap, self.best = seq, rt, max(min_hairpin, 3), best
        n = self.n = len(seq)
        none = -math.inf
        self.pair = np.full((n + 1, n + 1), none)  # i pairs j
        self.one = np.full((n + 1, n + 1), none)  # one branch from i, ending at or before j
        self.many = np.full((n + 2, n + 2), none)  # one branch or more within i..j
        self.can = {(i, j) for i in range(n) for j in range(i + self.gap + 1, n) if seq[i] + seq[j] in COMPLEMENTARY}
        for size in range(self.gap + 1, n):
            for i in range(n - size):
                j = i + size
                if (i, j) in self.can:
                    self.pair[i, j] = self._sum([w for w, _ in self._inside(i, j)])
                here = self.pair[i, j] - (MULTI_BRANCH + _weak(seq, i, j)) / rt
                self.one[i, j] = self._sum([self.one[i, j - 1], here])
                k = np.arange(i, j)
                before = self.many[i, k - 1]  # of none: -inf
                self.many[i, j] = self._sum(np.concatenate([self.one[k, j], before + self.one[k, j]]))
        self.outer = np.zeros(n + 1)
        for j in range(1, n + 1):
            self.outer[j] = self._sum([w for w, _ in self._outside(j)])

    def _sum(self, weights) -> float:
        w = np.asarray(weights, dtype=float)
        top = w.max() if len(w) else -math.inf
        return float(top) if self.best or top == -math.inf else float(top + math.log(np.exp(w - top).sum()))

    def _inside(self, i: int, j: int) -> list[tuple[float, tuple]]:
        s, rt = self.seq, self.rt
        out = [(-(_long(HAIRPIN, j - i - 1) + (_weak(s, i, j) if j - i - 1 == 3 else 0.0)) / rt, ("hairpin",))]
        for k in range(i + 1, min(i + LOOP_MOST + 2, j - self.gap - 1)):
            for m in range(max(k + self.gap + 1, j - 1 - (LOOP_MOST - (k - i - 1))), j):
                if (k, m) in self.can:
                    out.append((self.pair[k, m] - loop_energy(s, i, j, k, m) / rt, ("loop", k, m)))
        close = -(MULTI_CLOSE + MULTI_BRANCH + _weak(s, i, j)) / rt
        for k in range(i + self.gap + 3, j - self.gap - 1):
            w = self.many[i + 1, k - 1] + self.one[k, j - 1]
            if w > -math.inf:
                out.append((w + close, ("multi", k)))
        return out

    def _outside(self, j: int) -> list[tuple[float, tuple]]:
        out = [(self.outer[j - 1], ("skip",))]
        for i in range(0, j - self.gap - 1):
            if (i, j - 1) in self.can:
                out.append((self.outer[i] + self.pair[i, j - 1] - _weak(self.seq, i, j - 1) / self.rt, ("pair", i)))
        return out

    def _pick(self, options: list[tuple[float, tuple]], rng) -> tuple:
        w = np.array([x for x, _ in options])
        if self.best:
            return options[int(w.argmax())][1]
        p = np.cumsum(np.exp(w - w.max()))
        return options[min(len(options) - 1, int(np.searchsorted(p, rng.random_sample() * p[-1], side="right")))][1]

    def draw(self, rng) -> str:
        """One structure, with its Boltzmann probability; or the best one."""
        out = ["."] * self.n
        todo: list[tuple] = []
        j = self.n
        while j > 0:
            got = self._pick(self._outside(j), rng)
            if got[0] == "skip":
                j -= 1
            else:
                todo.append(("pair", got[1], j - 1))
                j = got[1]
        while todo:
            kind, i, j = todo.pop()
            if kind == "pair":
                out[i], out[j] = "(", ")"
                got = self._pick(self._inside(i, j), rng)
                if got[0] == "loop":
                    todo.append(("pair", *got[1:]))
                elif got[0] == "multi":
                    todo += [("many", i + 1, got[1] - 1), ("one", got[1], j - 1)]
            elif kind == "one":
                options = [(self.pair[i, m] - (MULTI_BRANCH + _weak(self.seq, i, m)) / self.rt, (m,)) for m in range(i + self.gap + 1, j + 1) if (i, m) in self.can]
                todo.append(("pair", i, self._pick(options, rng)[0]))
            else:
                options = []
                for k in range(i, j):
                    if self.one[k, j] > -math.inf:
                        options.append((self.one[k, j], (k, False)))
                        if k > i and self.many[i, k - 1] > -math.inf:
                            options.append((self.many[i, k - 1] + self.one[k, j], (k, True)))
                k, more = self._pick(options, rng)
                todo.append(("one", k, j))
                if more:
                    todo.append(("many", i, k - 1))
        return "".join(out)

    def _options(self, task: tuple) -> tuple[np.ndarray, list[float], list[tuple]]:
        """Shares, their running sums and what each choice leaves to do, for a part of the traceback."""
        kind, *at = task
        if kind == "outer":
            j = at[0]
            got = [(w, (("outer", j - 1),) if o[0] == "skip" else (("outer", o[1]), ("pair", o[1], j - 1))) for w, o in self._outside(j)]
        elif kind == "pair":
            i, j = at
            todo = {"hairpin": lambda o: (), "loop": lambda o: (("pair", *o[1:]),), "multi": lambda o: (("many", i + 1, o[1] - 1), ("one", o[1], j - 1))}
            got = [(w, todo[o[0]](o)) for w, o in self._inside(i, j)]
        elif kind == "one":
            i, j = at
            got = [(self.pair[i, m] - (MULTI_BRANCH + _weak(self.seq, i, m)) / self.rt, (("pair", i, m),)) for m in range(i + self.gap + 1, j + 1) if (i, m) in self.can]
        else:
            i, j = at
            got = [(self.one[k, j], (("one", k, j),)) for k in range(i, j)]
            got += [(self.many[i, k - 1] + self.one[k, j], (("one", k, j), ("many", i, k - 1))) for k in range(i + 1, j)]
        got = [x for x in got if x[0] > -math.inf]
        w = np.array([x for x, _ in got])
        share = np.exp(w - w.max())
        share /= share.sum()
        return share, np.cumsum(share).tolist(), [x for _, x in got]

    def draws(self, count: int, rng) -> dict[str, int]:
        """How often each structure comes in so many independent draws: draws that agree so far are one, and part by a multinomial."""
        known: dict[tuple, tuple] = {}
        out: dict[str, int] = {}
        stack = [(count, (("outer", self.n), None), None)]  # draws, what is left to do, pairs so far
        while stack:
            n, todo, pairs = stack.pop()
            while todo is not None:
                task, rest = todo
                if task[0] == "outer" and task[1] <= 0:
                    todo = rest
                    continue
                if task[0] == "pair":
                    pairs = (task, pairs)
                got = known.get(task)
                if got is None:
                    got = known[task] = self._options(task)
                share, sums, choices = got
                if len(choices) == 1:
                    times = [(0, n)]
                elif n <= _FEW:
                    picks = [min(len(choices) - 1, bisect_right(sums, rng.random_sample())) for _ in range(n)]
                    times = [(picks[0], 1)] if n == 1 else list(Counter(picks).items())
                else:
                    several = rng.multinomial(n, share)
                    times = [(k, int(several[k])) for k in np.flatnonzero(several).tolist()]
                for k, m in times[1:]:
                    more = rest
                    for x in choices[k]:
                        more = (x, more)
                    stack.append((m, more, pairs))
                k, n = times[0]
                todo = rest
                for x in choices[k]:
                    todo = (x, todo)
            text = ["."] * self.n
            while pairs is not None:
                (_, i, j), pairs = pairs
                text[i], text[j] = "(", ")"
            name = "".join(text)
            out[name] = out.get(name, 0) + n
        return out


def sample_structures(seq: str, p: Params, seed: int) -> Iterator[tuple[str, float]]:
    """Distinct structures with their energies: the best first, then as they are drawn, within the window, up to the cap."""
    if not seq:
        return
    rng = np.random.RandomState(seed % (1 << 32))
    best = Fold(seq, p.rt, p.min_hairpin, best=True).draw(rng)
    least = structure_energy(seq, best)
    limit = least + p.energy_window + p.tolerance
    seen = {best}
    yield best, least
    fold = Fold(seq, p.rt, p.min_hairpin)
    batch = min(p.max_structures, 500)
    counts = fold.draws(batch * (p.max_structures * 10 // batch + 1), rng)
    names = list(counts)
    # places in the sequence of draws are exchangeable: the first of m of them is the least of m uniform times
    first = np.log1p(-rng.random_sample(len(names))) / np.array([counts[s] for s in names])
    for k in np.argsort(-first, kind="stable").tolist():
        if len(seen) >= p.max_structures:
            return
        s = names[k]
        if s not in seen:
            e = structure_energy(seq, s)
            if e <= limit:
                seen.add(s)
                yield s, e


def sample(sequences: DataFrame, p: Params) -> DataFrame:
    """seq_id, run_id, null_id, ord, structure, energy, reason: num_runs samples of each sequence, each run with seed + run_id.

    sequences: seq_id, seq, and null_id (-1 for real ones) if it has one. One task for a sequence and run. A failure keeps what
    was drawn, and adds a row without a structure whose reason says what went wrong; a null or empty sequence is such a failure.
    """
    ship(sequences.sparkSession)
    has = "null_id" in sequences.columns
    jobs = sequences.select("seq_id", "seq", (F.col("null_id") if has else F.lit(-1)).cast("int").alias("null_id")).withColumn("run_id", F.explode(F.sequence(F.lit(0), F.lit(p.num_runs - 1))))
    jobs = jobs.repartition("seq_id", "run_id", "null_id")
    columns = ["seq_id", "run_id", "null_id", "ord", "structure", "energy", "reason"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                rows, why = [], None if r.seq else "no sequence"
                try:
                    for k, (s, e) in enumerate(sample_structures(r.seq, p, p.seed + r.run_id)):
                        rows.append((r.seq_id, r.run_id, r.null_id, k, s, e, None))
                except (ArithmeticError, IndexError, KeyError, ValueError) as err:
                    why = f"{type(err).__name__}: {err}"[:200]
                if why:
                    rows.append((r.seq_id, r.run_id, r.null_id, len(rows), None, None, why))
                yield pd.DataFrame(rows, columns=columns)

    return jobs.mapInPandas(run, "seq_id long, run_id int, null_id int, ord long, structure string, energy double, reason string")
