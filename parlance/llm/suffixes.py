"""Order of byte contexts by hash-compared suffix sort, and what each shares with another one.

A context is a place in a text with the bytes left and right of it. Prefix polynomial hashes are
taken outward from the place, to the right and to the left, so two contexts agree in ``t`` bytes on
a side exactly if their hashes at ``t`` agree, and binary search over ``t`` finds the common
extension. A comparison of two suffixes is one such search and one byte; the suffixes of all groups
of a batch are put in order by a mergesort that does all comparisons of a merge step together.
What is found by hashes is verified on the bytes; after a collision the batch is done again with
another base.
"""

from __future__ import annotations

import numpy as np

_PRIME = (1 << 61) - 1


def _weights(size: int, base: int) -> np.ndarray:
    out, w = [], 1
    for _ in range(size):
        w = w * base % _PRIME
        out.append(w)
    return np.array(out, np.uint64)


class Side:
    """One side of many contexts: bytes outward from the place, and their prefix hashes."""

    def __init__(self, groups: np.ndarray, parts: list[bytes], size: int, base: int):
        self.groups, self.size = groups, size
        self.lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        self.bytes = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in parts), np.uint8).reshape(len(parts), size)
        self.hashes = np.zeros((len(parts), size + 1), np.uint64)
        np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * _weights(size, base), axis=1, out=self.hashes[:, 1:])

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension of contexts x and y, by binary search over prefix hashes."""
        low, high = np.zeros(len(x), np.int64), np.minimum(self.lengths[x], self.lengths[y])
        for _ in range(self.size.bit_length()):
            middle = (low + high + 1) >> 1
            same = self.hashes[x, middle] == self.hashes[y, middle]
            low, high = np.where(same, middle, low), np.where(same, high, np.maximum(middle - 1, low))
        return low

    def before(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether suffix x sorts before y: by group, then bytes, then row."""
        out = self.groups[x] < self.groups[y]
        tied = np.flatnonzero(self.groups[x] == self.groups[y])
        a, b = x[tied], y[tied]
        t = self.common(a, b)
        a_ends, b_ends = t == self.lengths[a], t == self.lengths[b]
        at = np.minimum(t, self.size - 1)
        less = np.where(a_ends | b_ends, a_ends & (~b_ends | (a < b)), self.bytes[a, at] < self.bytes[b, at])
        out[tied] = less
        return out

    def order(self) -> np.ndarray:
        """Mergesort of all suffixes; every element looks for its place in the other run by binary search."""
        n, width = len(self.groups), 1
        order = np.arange(n)
        place = np.arange(n)
        while width < n:
            run = place // width
            other = np.minimum((run ^ 1) * width, n)
            end = np.minimum(other + width, n)
            low, high = other.copy(), end.copy()
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) >> 1
                less = self.before(order[middle], order[open_])
                low[open_] = np.where(less, middle + 1, low[open_])
                high[open_] = np.where(less, high[open_], middle)
            moved = np.empty_like(order)
            moved[(run & ~1) * width + (place - run * width) + (low - other)] = order
            order, width = moved, width * 2
        return order


def _shared(groups: np.ndarray, lefts: list[bytes], rights: list[bytes], span: int, base: int):
    n = len(groups)
    right = Side(groups, rights, span, base)
    left = Side(groups, [p[::-1] for p in lefts], max(map(len, lefts), default=0) or 1, base + 2)
    order = right.order()
    rank = np.empty(n, np.int64)
    rank[left.order()] = np.arange(n)
    x, y = order[:-1], order[1:]
    near = groups[x] == groups[y]
    depth = np.full(n, -1, np.int64)  # common bytes on the right with the next suffix in order; -1 at a group's end
    depth[:-1][near] = right.common(x[near], y[near])
    best_left, best_right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    partner_left, partner_right = np.full(n, -1), np.full(n, -1)
    steps = np.unique(np.stack([groups[order], -depth], axis=1)[depth > 0], axis=0)
    first = np.concatenate(([True], steps[1:, 0] != steps[:-1, 0])) if len(steps) else np.zeros(0, bool)
    turn = np.arange(len(steps)) - np.maximum.accumulate(np.where(first, np.arange(len(steps)), 0))
    limit = np.full(int(groups.max()) + 1 if n else 0, 1 << 30)
    for r in range(int(turn.max()) + 1 if len(turn) else 0):
        # groups of suffixes that agree in ``limit`` bytes on the right; the best partner is a neighbour on the left side
        now = steps[turn == r]
        limit[:] = 1 << 30
        limit[now[:, 0]] = -now[:, 1]
        joins = depth >= limit[groups[order]]
        inside = joins | np.concatenate(([False], joins[:-1]))
        cluster = np.cumsum(np.concatenate(([True], ~joins[:-1])))[inside]
        rows = order[inside]
        by_left = np.lexsort((rank[rows], cluster))
        rows, cluster = rows[by_left], cluster[by_left]
        same = np.flatnonzero(cluster[1:] == cluster[:-1])
        a, b = rows[same], rows[same + 1]
        t = left.common(a, b)
        enough = t + limit[groups[a]] >= span
        for me, other in ((a[enough], b[enough]), (b[enough], a[enough])):
            lefts_, rights_ = t[enough], limit[groups[me]]
            more = (lefts_ > best_left[me]) | (partner_left[me] < 0)
            best_left[me[more]], partner_left[me[more]] = lefts_[more], other[more]
            more = rights_ > best_right[me]
            best_right[me[more]], partner_right[me[more]] = rights_[more], other[more]
    for side, best, partner in ((left, best_left, partner_left), (right, best_right, partner_right)):
        me = np.flatnonzero(partner >= 0)
        for at in range(0, len(me), 4096):
            part = me[at : at + 4096]
            wrong = (side.bytes[part] != side.bytes[partner[part]]) & (np.arange(side.size) < best[part][:, None])
            if wrong.any() or (best[part] > np.minimum(side.lengths[part], side.lengths[partner[part]])).any():
                return None
    return best_left, best_right, partner_left >= 0


def shared(groups: np.ndarray, lefts: list[bytes], rights: list[bytes], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each context: bytes left and right that lie in a string of ``span`` bytes around the
    place which another context of its group has too, and whether there is any.

    ``groups`` ascends. If a context shares l bytes on the left and r on the right with another,
    l + r >= span, all strings of ``span`` bytes inside those l + r bytes occur at both. All such
    stretches hold the place itself, so their union is one stretch.
    """
    for base in (1_000_003, 998_244_353, 2_147_483_647):
        found = _shared(groups, lefts, rights, span, base)
        if found is not None:
            return found
    raise RuntimeError("three hash bases in a row met a collision")
