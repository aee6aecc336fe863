"""Triangles over the edges between two blocks of points, counted a batch of edges of about one length at a time.

What is longer than an edge and counts as equal to it, and what is shorter by more than delta, hardly changes from an edge to the next longer
one. So each point has a set of bits for either, which is moved along from batch to batch, and intersections of the sets of an edge's
ends are counted. Sides that may change their class within a batch are in no set: each triangle with one of them is looked at.
"""

from __future__ import annotations

import numpy as np

from ..params import Params

#: Edges of a batch; batches whose doubtful triangles are found together; such triangles for each edge on the whole, beyond which edges are left to ranks;
#: and at once.
BATCH, TOGETHER, LOOKED_AT, AT_ONCE = 512, 64, 32, 1 << 18
#: Relative width of what is in doubt around a limit because of rounding.
MARGIN = 1e-12
_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def ordered(d: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, rows, columns) of the finite distances between two blocks, ascending, equal ones by place; of one block each pair once.

    Numbers are sorted with their places in the last bits, which is many times faster than an argsort; what those bits have cut is mended.
    """
    n, m = d.shape
    keep = d < np.inf
    if same:
        keep &= np.triu(np.ones(d.shape, dtype=bool), 1)
    key = (np.arange(n * m) if keep.all() else np.flatnonzero(keep)).view(np.uint64)
    bits = np.uint64(max(1, (n * m - 1).bit_length()))
    flat_d = d.ravel()
    raw = (flat_d[key.view(np.int64)] + 0.0).view(np.uint64)
    top = np.uint64(1 << 63)
    if (raw & top).any():
        raw = np.where(raw & top, ~raw, raw | top)
    raw >>= bits
    raw <<= bits
    raw |= key
    raw.sort()
    flat = (raw & ((np.uint64(1) << bits) - np.uint64(1))).view(np.int64)
    values = flat_d[flat]
    if (values[1:] < values[:-1]).any():
        run = np.append(0, np.cumsum(np.diff(raw >> bits) > 0))
        some = np.flatnonzero(np.isin(run, run[1:][values[1:] < values[:-1]]))
        flat[some] = flat[some[np.lexsort((flat[some], values[some], run[some]))]]
        values = flat_d[flat]
    rows = (flat.astype(np.uint32) // np.uint32(m)).astype(np.int32)
    kind = np.int16 if max(n, m) < 1 << 15 else np.int32
    return values, rows.astype(kind), (flat - rows.astype(np.int64) * m).astype(kind)


def _spread(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, number) of each number in ranges that begin somewhere and have so many."""
    which = np.repeat(np.arange(len(count)), count)
    return which, np.arange(len(which)) + np.repeat(begin - (np.cumsum(count) - count), count)


class _Side:
    """The distances of the points of one end of the edges to the thirds, in order, and the sets of bits of each point."""

    def __init__(self, found: tuple[np.ndarray, np.ndarray, np.ndarray], d: np.ndarray, turned: bool, same: bool):
        self.d = d
        self.values, self.rows, self.columns = found
        if turned:
            self.rows, self.columns = self.columns, self.rows
        if same:  # each pair in both directions
            self.values = np.repeat(self.values, 2)
            self.rows, self.columns = (np.stack(x, axis=1).ravel() for x in ((self.rows, self.columns), (self.columns, self.rows)))
        n, m = d.shape
        self.height, self.width = n, -(-m // 64)
        self.word = self.rows.astype(np.int32) * self.width + (self.columns >> 6)
        self.shift = (self.columns & 63).astype(np.uint8)
        self.place = np.full(n * m, -1, dtype=np.int32)
        self.place[self.rows.astype(np.int64) * m + self.columns] = np.arange(len(self.values), dtype=np.int32)
        self.at = [0, 0, 0]

    def ranges(self, first: np.ndarray, last: np.ndarray, own: tuple[np.ndarray, np.ndarray] | None, ties: str, p: Params) -> None:
        """What is certain and what is in doubt for batches of edges of lengths from first to last; own: the places before and after
        the edges themselves, if they are among these distances; ties: whether equal distances are right or left of an edge."""
        find = self.values.searchsorted
        big_first, big_last = first > p.tolerance, last > p.tolerance
        with np.errstate(over="ignore"):
            h_low = find(np.where(big_first, first * (1 + p.epsilon) * (1 - MARGIN), p.tolerance), "right")
            h_high = find(np.where(big_last, last * (1 + p.epsilon) * (1 + MARGIN), p.tolerance), "right")
        s_low = find(np.where(big_first, first * (1 - p.delta) * (1 - MARGIN), -np.inf), "left")
        s_high = find(np.where(big_last, last * (1 - p.delta) * (1 + MARGIN), -np.inf), "right")
        b_low, b_high = own if own else (find(first, ties), find(last, ties))
        self.certain = np.stack([np.maximum(h_low, b_high), b_high, s_low])  # equal: from the second to the first; shorter: to the third
        self.begin = np.stack([s_low, b_low, np.maximum(h_low, b_high)]).astype(np.int32)
        self.end = np.maximum(self.begin, np.stack([np.minimum(s_high, b_low), b_high, np.maximum(h_high, b_high)])).astype(np.int32)

    def moves(self, batches: slice, at: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """What to add to the words of a table that has the sets of equal ones from a place on, behind them those of shorter ones: (words,
        what is added, where each batch ends) three times."""
        out = []
        for k, ends in enumerate(self.certain[:, batches]):
            a, self.at[k] = self.at[k], int(ends[-1])
            bits = _BITS.take(self.shift[a : self.at[k]])
            words = self.word[a : self.at[k]] + np.int32(at if k < 2 else at + self.height * self.width)
            out.append((words, np.negative(bits, out=bits) if k == 1 else bits, ends - a))
        return out

    def doubtful(self, batches: slice, count: np.ndarray, height: int) -> tuple[np.ndarray, np.ndarray]:
        """(batch times height, from 0; place) of the distances in doubt at points of which a batch has edges: count has their number."""
        found = []
        for begin, end in zip(self.begin[:, batches], self.end[:, batches], strict=True):
            many = end - begin
            batch = np.repeat(np.arange(0, len(many) * height, height, dtype=np.int32), many)
            place = np.arange(len(batch), dtype=np.int32)
            place += np.repeat(begin - (np.cumsum(many, dtype=np.int32) - many), many)
            some = np.flatnonzero(count.take(batch + self.rows.take(place)))
            found.append((batch[some], place[some]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def in_doubt(self, batch: np.ndarray, flat: np.ndarray) -> np.ndarray:
        place, found = self.place.take(flat), np.zeros(len(flat), dtype=bool)
        for begin, end in zip(self.begin, self.end, strict=True):
            found |= (place >= begin.take(batch)) & (place < end.take(batch))
        return found


def _classes(e: np.ndarray, d: np.ndarray, first: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(which d are longer than e and equal to it, which are shorter) as `triplets.label_counts` says it; of equal ones those of `first` are longer."""
    big = e > p.tolerance
    m = np.where(big, e, 1.0)
    with np.errstate(over="ignore", invalid="ignore"):
        equal = ((d > e) | ((d == e) & first)) & np.where(big, (d - m) / m <= p.epsilon, d <= p.tolerance)
        return equal, big & ((m - d) / m > p.delta)


def swept(edges: tuple[np.ndarray, np.ndarray, np.ndarray], shape: tuple[int, int], left: _Side, right: _Side, order: tuple[int, int, int], p: Params) -> tuple[int, int, np.ndarray | None]:
    """(nontrivial, trivial) triangles over edges between the blocks u <= v, in order, with thirds of w: as `triplets._edges`; and the places of edges
    that are left out because too many sides are in doubt there."""
    e, ei, ej = edges
    u, v, w = order
    total = len(e)
    if not total or not len(left.values) or not len(right.values):
        return 0, 0, None
    start = np.arange(0, total, BATCH)
    stop = np.minimum(start + BATCH, total)
    for side, block in ((left, u), (right, v)):
        pair = (min(block, w), max(block, w))
        own = None
        if pair == (u, v):
            own = (start * 2, stop * 2) if u == v else (start, stop)
        side.ranges(e[start], e[stop - 1], own, "right" if pair < (u, v) else "left", p)
    nt = tr = 0
    rest: list[np.ndarray] = []
    left_to_look = LOOKED_AT * total
    height, thirds, width = max(shape), left.d.shape[1], left.width
    table = np.zeros(2 * sum(shape) * width, dtype=np.uint64)
    sets = np.split(table.reshape(-1, width), np.cumsum([shape[0], shape[0], shape[1]]))
    room = np.empty((4, BATCH, width), dtype=np.uint64)
    ones = np.empty((BATCH, width), dtype=np.uint8)
    for b in range(0, len(start), TOGETHER):
        batches = slice(b, min(b + TOGETHER, len(start)))
        a, z = int(start[b]), int(stop[batches.stop - 1])
        of = np.repeat(np.arange(0, (batches.stop - b) * height, height), stop[batches] - start[batches])
        looks = []
        for side, ends in ((left, ei), (right, ej)):
            key = of + ends[a:z]
            count = np.bincount(key, minlength=(batches.stop - b) * height)
            batch, place = side.doubtful(batches, count, height)
            mine = batch + side.rows.take(place)
            looks.append((batch // height + b, place, key, count, mine, count.take(mine)))
        many = sum(int(x[5].sum()) for x in looks)
        if many > left_to_look:
            rest.append(np.arange(a, z))
            continue
        left_to_look -= many
        for k, (batch, place, key, count, mine, often) in enumerate(looks):
            side, other, near, far = (left, right, ei, ej) if k == 0 else (right, left, ej, ei)
            own, across = (u, v) if k == 0 else (v, u)
            by_key = key << 32 | np.arange(z - a)
            by_key.sort()  # many times faster than an argsort
            by_key = (by_key & 0xFFFFFFFF) + a
            first = np.cumsum(count) - count
            cuts = np.flatnonzero(np.diff(np.cumsum(often) // AT_ONCE)) + 1
            for some in np.split(np.arange(len(mine)), cuts):
                which, at = _spread(first[mine[some]], often[some])
                which = some[which]
                edge = by_key[at]
                third = side.columns.take(place[which])
                flat = far[edge].astype(np.int64) * thirds + third
                if k == 1:  # those in doubt on both sides have been looked at
                    new = np.flatnonzero(~other.in_doubt(batch[which], flat))
                    which, edge, third, flat = which[new], edge[new], third[new], flat[new]
                comes = lambda block, ends, third=third, edge=edge: third > ends[edge] if w == block else np.full(len(third), w > block)
                length = e[edge]
                equal, short = _classes(length, side.values.take(place[which]), comes(across, far), p)
                equal_far, short_far = _classes(length, other.d.ravel()[flat], comes(own, near), p)
                tr += int((equal & equal_far).sum())
                nt += int(((equal & short_far) | (short & equal_far)).sum())
        moves = [*left.moves(batches, 0), *right.moves(batches, 2 * shape[0] * width)]
        done = [0] * len(moves)
        for k in range(b, batches.stop):
            until = [int(m[2][k - b]) for m in moves]
            np.add.at(table, np.concatenate([m[0][x:y] for m, x, y in zip(moves, done, until, strict=True)]), np.concatenate([m[1][x:y] for m, x, y in zip(moves, done, until, strict=True)]))
            done = until
            s, t = int(start[k]), int(stop[k])
            le, ls, re, rs = (x[: t - s] for x in room)
            for ends, tables, found in ((ei[s:t], sets[:2], (le, ls)), (ej[s:t], sets[2:], (re, rs))):
                for x, y in zip(tables, found, strict=True):
                    x.take(ends, axis=0, out=y, mode="clip")
            rs &= le
            ls &= re
            le &= re
            rs |= ls  # no third is in both
            tr += int(np.bitwise_count(le, out=ones[: t - s]).sum(dtype=np.uint32))
            nt += int(np.bitwise_count(rs, out=ones[: t - s]).sum(dtype=np.uint32))
    return nt, tr, np.concatenate(rest) if rest else None
