"""Vantage-point trees over norm-augmented vectors, and searches in score windows.

A vector x of whole numbers gets one more component, the root of M2 - |x|^2, with M2 the largest squared length of all; a query q
gets 0. Then |q - x|^2 = |q|^2 + M2 - 2 (q, x): the larger the inner product, the nearer the row, and a window of scores
is an annulus around the query. A node cuts its rows in half by distance from a vantage point; by the triangle inequality
a query's distance from the vantage point bounds its distance from all rows of either half.

All bounds are widened by a little more than rounding errs, so nothing is lost; scores themselves are exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Rows of a leaf, which are scored together.
LEAF_ROWS = 256
NO_ID = np.iinfo(np.int64).max


def augmented(x: np.ndarray, m2: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(0.0, m2 - (x * x).sum(1)))[:, None]])


def distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, ((points - to) ** 2).sum(1)))


def depth_for(rows: int, leaf: int) -> int:
    """Levels of cuts after which no leaf has more than ``leaf`` rows."""
    return max(0, int(np.ceil(np.log2(max(1, rows) / leaf))))


@dataclass
class Tree:
    """A balanced tree. Nodes are numbered as in a heap; ``low`` and ``high`` say how far a node's rows are from the
    vantage point of the node above; leaf i holds rows edges[i] to edges[i + 1] of ``order``."""

    vantage: np.ndarray  # a row for each inner node, augmented
    low: np.ndarray
    high: np.ndarray
    edges: np.ndarray
    order: np.ndarray

    @property
    def depth(self) -> int:
        return len(self.edges).bit_length() - 1 if len(self.edges) > 1 else 0


def build(points: np.ndarray, depth: int) -> Tree:
    """A tree of 2^depth leaves over augmented points. A node's vantage point is its row farthest from its first one; rows at equal distances are cut by place."""
    order, inner = np.arange(len(points)), (1 << depth) - 1
    vantage = np.zeros((inner, points.shape[1]))
    low, high = np.zeros(2 * inner + 1), np.full(2 * inner + 1, np.inf)
    spans = [(0, len(points))]
    for node in range(inner):
        a, b = spans[node]
        m = (a + b + 1) // 2
        if b > a:
            own = points[order[a:b]]
            vantage[node] = own[np.argmax(distances(own, own[0]))]
            d = distances(own, vantage[node])
            by = np.argsort(d, kind="stable")
            order[a:b], d = order[a:b][by], d[by]
            low[2 * node + 1], high[2 * node + 1] = d[0], d[m - a - 1]
            if m < b:
                low[2 * node + 2], high[2 * node + 2] = d[m - a], d[-1]
        spans += [(a, m), (m, b)]
    return Tree(vantage, low, high, np.array([a for a, _ in spans[inner:]] + [len(points)]), order)


def leaf_bounds(tree: Tree, q: np.ndarray, qq: np.ndarray, m2: float) -> tuple[np.ndarray, np.ndarray]:
    """For each query and leaf: how near and how far its rows can be, level by level from the root."""
    near, far = np.zeros((len(q), 1)), np.full((len(q), 1), np.inf)
    to = np.sqrt(np.maximum(0.0, (qq + m2)[:, None] - 2 * (q @ tree.vantage[:, :-1].T))) if len(tree.vantage) else None
    first = 0
    while first < len(tree.vantage):
        n = near.shape[1]
        d = np.repeat(to[:, first : first + n], 2, axis=1)
        low, high = tree.low[2 * first + 1 : 2 * first + 1 + 2 * n], tree.high[2 * first + 1 : 2 * first + 1 + 2 * n]
        near = np.maximum(np.repeat(near, 2, axis=1), np.maximum(d - high, low - d))
        far = np.minimum(np.repeat(far, 2, axis=1), d + high)
        first = 2 * first + 1
    return near, far


def annulus(qq: np.ndarray, m2: float, lowest: np.ndarray, highest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distances of the rows with scores from ``lowest`` to ``highest``, and by how much to widen them."""
    square = lambda s: np.sqrt(np.maximum(0.0, qq + m2 - 2 * s))
    slack = 1e-6 * (1 + np.sqrt(qq + m2))
    return square(highest) - slack, square(lowest) + slack, slack


@dataclass
class Queries:
    """Queries of one search: number, own vector id, vector, squared length, label, and the window of scores."""

    qid: np.ndarray
    own: np.ndarray
    q: np.ndarray
    qq: np.ndarray
    label: np.ndarray
    lowest: np.ndarray
    highest: np.ndarray


@dataclass
class Rows:
    """Rows of one block in the order of its tree."""

    tree: Tree
    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray


def search(rows: Rows, qs: Queries, m2: float, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The first k rows of each query by score, then id, among rows of its window and of its own label (``same``) or
    another one, without rows of its own id: places of queries, scores, ids; and how many leaves were scored.

    Each query takes the leaves in its annulus nearest first, until the next one begins beyond its k-th row."""
    near, far = leaf_bounds(rows.tree, qs.q, qs.qq, m2)
    inner, outer, slack = annulus(qs.qq, m2, qs.lowest, qs.highest)
    key = np.maximum(near, inner[:, None])
    key[(near > outer[:, None]) | (far + slack[:, None] < inner[:, None]) | (np.diff(rows.tree.edges) == 0)] = np.inf
    turn, reach = np.argsort(key, axis=1, kind="stable"), outer.copy()
    kth = np.full(len(qs.q), -np.inf)
    held_q, held_s, held_i, scored = np.empty(0, int), np.empty(0), np.empty(0, np.int64), 0
    for t in range(key.shape[1]):
        leaf = turn[:, t]
        next_key = key[np.arange(len(leaf)), leaf]
        asks = np.flatnonzero((next_key <= reach) & (next_key < np.inf))
        if not len(asks):
            break
        new_q, new_s, new_i = [held_q], [held_s], [held_i]
        by = asks[np.argsort(leaf[asks], kind="stable")]
        for own in np.split(by, np.flatnonzero(np.diff(leaf[by])) + 1):
            a, b = rows.tree.edges[leaf[own[0]]], rows.tree.edges[leaf[own[0]] + 1]
            s = qs.q[own] @ rows.x[a:b].T
            fits = (rows.labels[a:b] == qs.label[own, None]) == same
            fits &= (rows.ids[a:b] != qs.own[own, None]) & (s >= np.maximum(qs.lowest, kth)[own, None]) & (s <= qs.highest[own, None])
            if b - a > k:
                best = np.where(fits, s, -np.inf)
                fits &= s >= np.partition(best, b - a - k, axis=1)[:, b - a - k, None]
            r, c = np.nonzero(fits)
            new_q.append(own[r])
            new_s.append(s[r, c])
            new_i.append(rows.ids[a:b][c])
            scored += len(own)
        held_q, held_s, held_i = map(np.concatenate, (new_q, new_s, new_i))
        first = np.lexsort((held_i, -held_s, held_q))
        held_q, held_s, held_i = held_q[first], held_s[first], held_i[first]
        place = np.arange(len(held_q)) - np.searchsorted(held_q, held_q)
        held_q, held_s, held_i, place = (x[place < k] for x in (held_q, held_s, held_i, place))
        full = place == k - 1
        kth[held_q[full]] = held_s[full]
        done = np.isfinite(kth)
        reach[done] = np.minimum(outer[done], np.sqrt(np.maximum(0.0, qs.qq[done] + m2 - 2 * kth[done])) + 2 * slack[done])
    return held_q, held_s, held_i, scored
