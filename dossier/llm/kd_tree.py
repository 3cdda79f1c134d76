"""A kd-tree of integer vectors that assigns them to centroids by filtering.

Every node holds its points' box, count and integer sums. Walking down with all
centroids, a node drops a centroid that some other one beats at every point of
the box; left with one, the whole node is that centroid's. Leaves compare the
rest point by point. All numbers are integers of 64 bits, so nothing is rounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

LEAF = 16
#: Components up to here in size: squared distances, and what the walk compares, stay below 2^63 for 64 components.
LARGEST = 1 << 25
#: Below this, every intermediate number of a matrix product is an integer that a double holds.
DOUBLES = 1 << 22


@dataclass
class KdTree:
    """Nodes in the order they were made; `child` is the first of a node's two, 0 for a leaf. Points lie in node order."""

    points: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    child: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = LEAF) -> tuple[KdTree, np.ndarray]:
        """(tree, the order that its points were put in): boxes are halved at the median of their widest side."""
        order, begin, end, child = np.arange(len(points)), [0], [len(points)], []
        low, high, sums = [], [], []
        for lo, hi in _growing(begin, end):
            part = points[order[lo:hi]]
            low.append(part.min(axis=0))
            high.append(part.max(axis=0))
            sums.append(part.sum(axis=0))
            side = int(np.argmax(high[-1] - low[-1]))
            if hi - lo <= leaf or high[-1][side] == low[-1][side]:  # equal points are a leaf of any size
                child.append(0)
                continue
            middle = (lo + hi) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(part[:, side], middle - lo, kind="introselect")]
            child.append(len(begin))
            begin += [lo, middle]
            end += [middle, hi]
        whole = lambda x: np.array(x, np.int64)
        return cls(points[order], whole(begin), whole(end), whole(child), whole(low), whole(high), whole(sums)), order

    def walk(self, centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(nodes, which centroids each may have): nodes of a single centroid, and leaves of several; together they are all points."""
        nodes, open_to = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
        while len(nodes):
            low, high = self.low[nodes], self.high[nodes]
            off = ((2 * centroids[None] - (low + high)[:, None]) ** 2).sum(axis=2)
            off[~open_to] = np.iinfo(np.int64).max
            best = centroids[off.argmin(axis=1)]
            way = centroids[None] - best[:, None]
            corner = np.where(way > 0, high[:, None], low[:, None])  # where the centroid stands best against the best one
            behind = (way * (centroids[None] + best[:, None] - 2 * corner)).sum(axis=2)
            open_to = open_to & (behind <= 0)
            done = (open_to.sum(axis=1) == 1) | (self.child[nodes] == 0)
            if done.any():
                yield nodes[done], open_to[done]
            left, rest = self.child[nodes[~done]], open_to[~done]
            nodes, open_to = np.concatenate([left, left + 1]), np.concatenate([rest, rest])

    def _leaves(self, nodes: np.ndarray, open_to: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the leaves' points, the nearest open centroid of each; the smaller number of equal ones)."""
        n = self.end[nodes] - self.begin[nodes]
        place = np.repeat(self.begin[nodes] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        far = distances(self.points[place], centroids)
        far[~np.repeat(open_to, n, axis=0)] = np.iinfo(np.int64).max
        return place, far.argmin(axis=1)

    def totals(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, sums) of the points of each centroid."""
        count, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for nodes, open_to in self.walk(centroids):
            alone = open_to.sum(axis=1) == 1
            whose, mine = open_to[alone].argmax(axis=1), nodes[alone]
            np.add.at(count, whose, self.end[mine] - self.begin[mine])
            np.add.at(sums, whose, self.sums[mine])
            if not alone.all():
                place, whose = self._leaves(nodes[~alone], open_to[~alone], centroids)
                for c in np.unique(whose):
                    mine = place[whose == c]
                    count[c] += len(mine)
                    sums[c] += self.points[mine].sum(axis=0)
        return count, sums

    def labels(self, centroids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.points), np.int64)
        for nodes, open_to in self.walk(centroids):
            alone = open_to.sum(axis=1) == 1
            for node, whose in zip(nodes[alone], open_to[alone].argmax(axis=1), strict=True):
                out[self.begin[node] : self.end[node]] = whose
            if not alone.all():
                place, whose = self._leaves(nodes[~alone], open_to[~alone], centroids)
                out[place] = whose
        return out


def _growing(begin: list[int], end: list[int]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(begin):
        yield begin[at], end[at]
        at += 1


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, points x centroids."""
    if max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) < DOUBLES:
        x, c = points.astype(np.float64), centroids.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(axis=1) for c in centroids], axis=1) if len(centroids) else np.zeros((len(points), 0), np.int64)
