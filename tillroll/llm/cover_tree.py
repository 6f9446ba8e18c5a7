"""A cover tree over norm-augmented vectors, in numpy, for exact inner-product search.

Every vector x gets one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm, so that
|q - x|^2 = |q|^2 + M^2 - 2 q.x for a query with 0 there: nearest means largest product. A node
covers its members within its radius; its children are centres that lie apart, each covering what
is within half of that radius, so the covering radii halve level by level. A ball bounds the inner
products of its members from both sides.
"""

from __future__ import annotations

import heapq
import io
from dataclasses import dataclass

import numpy as np

#: nodes of at most so many members are not split further
LEAF = 8
_EXACT = 2.0**52


def _whole(points: np.ndarray) -> np.ndarray:
    """As Python integers, exact at any size."""
    return np.array([int(x) for x in points.ravel()], object).reshape(points.shape)


@dataclass
class Window:
    """The ``k`` best of the scores from ``low`` to ``high``; ties by id (none last), then row."""

    low: float
    high: float
    k: int
    found: list[tuple]

    def limit(self) -> float:
        """A score below this can no longer enter."""
        return max(self.low, -self.found[-1][0]) if len(self.found) >= self.k else self.low

    def offer(self, score: np.ndarray, member: np.ndarray, tree: CoverTree) -> None:
        hit = np.flatnonzero((score >= self.limit()) & (score <= self.high))
        if len(hit) > self.k:
            least = np.partition(score[hit].astype(np.float64), -self.k)[-self.k]
            hit = hit[score[hit] >= least]
        if len(hit):
            new = zip(score[hit].tolist(), member[hit].tolist())
            keyed = ((-int(s), tree.unnamed[m], int(tree.ids[m]), int(tree.rows[m])) for s, m in new)
            self.found = heapq.nsmallest(self.k, [*self.found, *keyed])


class CoverTree:
    """Built over one block of vectors. ``ids`` may lack values where ``unnamed`` is set."""

    _SAVED = ("points", "rows", "ids", "unnamed", "labels", "node", "radius", "children", "members", "order")

    def __init__(self, points, rows, ids, unnamed, labels):
        self.points, self.rows, self.ids = points, rows, ids
        self.unnamed, self.labels = unnamed, labels
        self._build()
        self._ready()

    def _build(self) -> None:
        x = self.points.astype(np.float64)
        norm = (x * x).sum(axis=1)
        lifted = np.column_stack([x, np.sqrt(np.maximum(norm.max(initial=0.0) - norm, 0.0))])
        node, radius, children, members, order = [], [], [], [], []
        level = [np.arange(len(x))] if len(x) else []
        while level:  # level by level, so that siblings lie side by side
            below, at = [], len(node) + len(level)
            for own in level:
                far = np.sqrt(((lifted[own] - lifted[own[0]]) ** 2).sum(axis=1))
                node.append(own[0])
                radius.append(far.max())
                if radius[-1] == 0.0 or len(own) <= LEAF:
                    members.append((len(order), len(order) + len(own)))
                    children.append((0, 0))
                    order.extend(own.tolist())
                    continue
                split = self._split(lifted, own, far, radius[-1] / 2)
                members.append((0, 0))
                children.append((at + len(below), at + len(below) + len(split)))
                below += split
            level = below
        self.node, self.radius = np.array(node, np.int64), np.array(radius, np.float64)
        self.children = np.array(children, np.int64).reshape(-1, 2)
        self.members = np.array(members, np.int64).reshape(-1, 2)
        self.order = np.array(order, np.int64)

    @staticmethod
    def _split(lifted, own, far, reach) -> list[np.ndarray]:
        """Centres more than ``reach`` apart, each with what it is the first to cover."""
        parts, left, distance = [], own, far
        while len(left):
            near = distance <= reach
            near[0] = True
            parts.append(left[near])
            left = left[~near]
            if len(left):
                distance = np.sqrt(((lifted[left] - lifted[left[0]]) ** 2).sum(axis=1))
        return parts

    def _ready(self) -> None:
        x = self.points.astype(np.float64)
        norm = (x * x).sum(axis=1)
        self.most = float(norm.max(initial=0.0))
        self.exact = x if self.most < _EXACT else _whole(self.points)
        self.centres = self.exact[self.node]
        kinds = self.labels[self.order]
        n = len(self.node)
        self.least, self.largest = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for i in range(n - 1, -1, -1):  # children stand behind their node
            a, b = self.children[i]
            c, d = self.members[i]
            low, high = (self.least[a:b], self.largest[a:b]) if b > a else (kinds[c:d],) * 2
            self.least[i], self.largest[i] = low.min(), high.max()

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{n: getattr(self, n) for n in self._SAVED})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> CoverTree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as saved:
            for name in cls._SAVED:
                setattr(tree, name, saved[name])
        tree._ready()
        return tree

    def _offer(self, members, score, query_row, label, same, windows) -> None:
        fits = (self.labels[members] == label) == same
        if same:
            fits &= self.rows[members] != query_row
        members, score = members[fits], score[fits]
        for window in windows:
            window.offer(score, members, self)

    def search(self, query, query_row: int, label: int, same: bool, windows: list[Window]) -> None:
        """Fill ``windows`` with members of the query's label (``same``) or of others.

        Nodes are taken by their upper bound, highest first. One whose bounds lie outside every
        window, or below what a full window still admits, is skipped with all it covers.
        """
        if not len(self.node) or not windows:
            return
        wide = query.astype(np.float64)
        own = float(wide @ wide)
        use = wide if max(self.most, own) < _EXACT else _whole(query)
        points = self.exact if use is wide or self.most >= _EXACT else _whole(self.points)
        centres = points[self.node] if points is not self.exact else self.centres
        both, slack = own + self.most, 1e-6 * (own + self.most) + 1e-6

        def bounds(a: int, b: int):
            score = centres[a:b] @ use
            wide_score = score.astype(np.float64)
            r = self.radius[a:b]
            apart = np.sqrt(np.maximum(both - 2 * wide_score, 0.0))
            reach = np.sqrt(own) * r
            high = np.minimum(wide_score + reach, (both - np.maximum(apart - r, 0.0) ** 2) / 2)
            low = np.maximum(wide_score - reach, (both - (apart + r) ** 2) / 2)
            return score, low - slack, high + slack

        heap: list[tuple[float, float, int]] = []

        def take(a: int, b: int) -> None:
            score, low, high = bounds(a, b)
            if same:
                useful = (self.least[a:b] <= label) & (label <= self.largest[a:b])
            else:
                useful = ~((self.least[a:b] == label) & (self.largest[a:b] == label))
            point = (self.radius[a:b] == 0.0) & useful
            single = np.flatnonzero(point)
            if len(single):  # members of a point all have its score
                first, last = self.members[a:b][single].T
                n = last - first
                at = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                self._offer(self.order[at], np.repeat(score[single], n), query_row, label, same, windows)
            for i in np.flatnonzero(useful & ~point).tolist():
                if self._open(low[i], high[i], windows):
                    heapq.heappush(heap, (-high[i], low[i], a + i))

        take(0, 1)
        while heap:
            high, low, i = heapq.heappop(heap)
            if not self._open(low, -high, windows):
                continue
            a, b = self.children[i]
            if b > a:
                take(a, b)
            else:
                own_members = self.order[slice(*self.members[i])]
                self._offer(own_members, points[own_members] @ use, query_row, label, same, windows)

    @staticmethod
    def _open(low: float, high: float, windows: list[Window]) -> bool:
        return any(low <= w.high and min(high, w.high) >= w.limit() for w in windows)
