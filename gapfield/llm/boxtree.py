"""A tree of bounding boxes over integer vectors, packed by sort-tile-recursive.

Rows are ordered by label first and then, slab by slab, along the coordinates of largest variance;
every ``LEAF`` rows in that order share a box, every ``FANOUT`` boxes the box above. A box holds the
least and the largest value per coordinate, hence an interval for the inner product with any query,
and the least and the largest label. Inner products of integers are exact: in double precision
where every sum stays below 2^53, in 64-bit integers otherwise.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

LEAF = 64
FANOUT = 16
_NONE = np.iinfo(np.int64).min
_LAST = np.iinfo(np.int64).max


def tiled(points: np.ndarray, capacity: int = LEAF) -> np.ndarray:
    """Order of the rows in which runs of ``capacity`` rows are the tiles of sort-tile-recursive."""
    n, dims = points.shape
    axes = np.argsort(-points.var(0), kind="stable") if n else np.arange(dims)
    done, open_ = [], [(np.arange(n), 0)]
    while open_:
        rows, depth = open_.pop()
        if len(rows) <= capacity or depth == dims:
            done.append(rows)
            continue
        pages = -(-len(rows) // capacity)
        slabs = int(np.ceil(pages ** (1 / (dims - depth))))
        rows = rows[np.argsort(points[rows, axes[depth]], kind="stable")]
        each = capacity * -(-pages // slabs)
        open_ += [(rows[i : i + each], depth + 1) for i in range(0, len(rows), each)][::-1]
    return np.concatenate(done) if done else np.zeros(0, np.int64)


@dataclass
class BoxTree:
    points: np.ndarray  # rows in packed order
    labels: np.ndarray
    ids: np.ndarray  # what ties are broken by; nulls are the largest
    uids: np.ndarray
    boxes: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # per level from the leaves: lo, hi, least and largest label


def build(points: np.ndarray, labels: np.ndarray, ids: np.ndarray, uids: np.ndarray) -> BoxTree:
    by_label = np.argsort(labels, kind="stable")
    cuts = np.flatnonzero(np.diff(labels[by_label])) + 1
    order = np.concatenate([own[tiled(points[own])] for own in np.split(by_label, cuts)]) if len(points) else by_label
    points, labels = np.ascontiguousarray(points[order]), labels[order]
    boxes, level = [], (points, points, labels, labels)
    each = LEAF
    while not boxes or len(boxes[-1][0]) > 1:
        starts = np.arange(0, len(level[0]), each)
        if not len(starts):
            break
        level = tuple(f.reduceat(x, starts, axis=0) for f, x in zip((np.minimum, np.maximum, np.minimum, np.maximum), level, strict=True))
        boxes.append(level)
        each = FANOUT
    return BoxTree(points, labels, ids[order], uids[order], boxes)


class _Top:
    """The first ``k`` hits per query: larger scores first, ties by smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), _NONE)
        self.id = np.full((queries, k), _LAST)
        self.row = np.full((queries, k), -1)

    @property
    def kth(self) -> np.ndarray:
        return self.score[:, -1]

    def offer(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        own = np.unique(query)
        q = np.concatenate([query, np.repeat(own, self.k)])
        s = np.concatenate([score, self.score[own].ravel()])
        i = np.concatenate([ids, self.id[own].ravel()])
        r = np.concatenate([row, self.row[own].ravel()])
        # a slot without a hit holds the least score, so it sorts behind every hit
        order = np.lexsort((r, i, ~s, q))
        first = np.searchsorted(q[order], own)
        at = order[first[:, None] + np.arange(self.k)]
        self.score[own], self.id[own], self.row[own] = s[at], i[at], r[at]


def search(tree: BoxTree, queries: np.ndarray, labels: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> _Top:
    """First ``k`` rows per query with a score in [low, high] and the same (or another) label; row ``own`` is left out.

    One queue, best first, serves a block of queries: an entry is a box with the queries that still
    ask for it, ordered by the best score that any of them can find there. A query leaves a box whose
    interval misses its window, whose labels can't serve it, or whose upper end is strictly below the
    query's k-th hit.
    """
    top = _Top(len(queries), k)
    if not len(queries) or not len(tree.points):
        return top
    # Python integers: the absolute value of the least 64-bit number doesn't fit one
    most = max(abs(int(tree.points.max(initial=0))), abs(int(tree.points.min(initial=0)))) * max(abs(int(queries.max(initial=0))), abs(int(queries.min(initial=0))))
    kind = np.float64 if most * max(1, queries.shape[1]) < 1 << 53 else np.int64
    asked = queries.astype(kind)
    plus, minus = np.maximum(asked, 0), np.minimum(asked, 0)
    queue, pushed = [], 0

    def push(level: int, first: int, last: int, active: np.ndarray) -> None:
        nonlocal pushed
        lo, hi, least, largest = (x[first:last] for x in tree.boxes[level])
        lo, hi = lo.astype(kind), hi.astype(kind)
        upper = (hi @ plus[active].T + lo @ minus[active].T).astype(np.int64)
        lower = (lo @ plus[active].T + hi @ minus[active].T).astype(np.int64)
        mine = labels[active]
        fits = (least[:, None] <= mine) & (mine <= largest[:, None]) if same else (least[:, None] != mine) | (largest[:, None] != mine)
        fits &= (lower <= high[active]) & (upper >= np.maximum(low[active], top.kth[active]))
        best = np.where(fits, np.minimum(upper, high[active]), _NONE)
        for j in np.flatnonzero(fits.any(1)):
            heapq.heappush(queue, (-int(best[j].max()), pushed, level, first + int(j), active[fits[j]], upper[j, fits[j]]))
            pushed += 1

    push(len(tree.boxes) - 1, 0, 1, np.arange(len(queries)))
    while queue:
        _, _, level, node, active, upper = heapq.heappop(queue)
        active = active[upper >= top.kth[active]]
        if not len(active):
            continue
        if level:
            push(level - 1, node * FANOUT, min((node + 1) * FANOUT, len(tree.boxes[level - 1][0])), active)
            continue
        rows = slice(node * LEAF, (node + 1) * LEAF)
        score = (tree.points[rows].astype(kind) @ asked[active].T).astype(np.int64)
        match = tree.labels[rows][:, None] == labels[active]
        ok = (match if same else ~match) & (tree.uids[rows][:, None] != own[active])
        ok &= (score <= high[active]) & (score >= np.maximum(low[active], top.kth[active]))
        r, q = np.nonzero(ok)
        if len(r):
            top.offer(active[q], score[r, q], tree.ids[rows][r], node * LEAF + r)
    return top
