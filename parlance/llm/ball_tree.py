"""A ball tree over sparse non-negative vectors, searched for the largest inner products.

Vectors hold integer impacts, queries are sets of terms, and the product is the sum of a
vector's impacts over a query's terms. A node knows its centroid and how far its vectors lie
from it. Terms are dealt to groups, and a node keeps a radius for each group beside the one
over all terms: by Cauchy and Schwarz no vector of the node can exceed the centroid's product
by more than the radii times the norms of the query's parts, whichever way is less. Bounds are
rounded up by more than the arithmetic can lose, so nothing is ever pruned that could count.
"""

from __future__ import annotations

import heapq

import numpy as np

from parlance.llm.blocks import ragged

#: Vectors of a leaf, and groups of terms.
LEAF = 32
GROUPS = 256
#: Share of the quantities behind a radius, and of a bound, that rounding may cost.
SLACK = 1e-10


class Queries:
    """Distinct terms of each query, one query after another, with the groups of the terms."""

    def __init__(self, terms: list[np.ndarray], n_terms: int):
        self.terms = terms
        self.sizes = np.array([len(t) for t in terms], np.int64)
        self.flat = np.concatenate([np.empty(0, np.int64), *terms]).astype(np.int64)
        self.limits = np.concatenate(([0], np.cumsum(self.sizes)))
        owner = np.repeat(np.arange(len(terms)), self.sizes)
        first = np.full(n_terms, len(terms))
        np.minimum.at(first, self.flat, owner)
        self.group = (first % GROUPS).astype(np.int64)  # terms that begin in a query go together
        parts = np.bincount(owner * GROUPS + self.group[self.flat], minlength=len(terms) * GROUPS)
        self.parts = np.sqrt(parts.reshape(len(terms), GROUPS).astype(float))

    def products(self, dense: np.ndarray) -> np.ndarray:
        """Inner product of every query with a dense vector."""
        total = np.concatenate(([0.0], np.cumsum(dense[self.flat])))
        return total[self.limits[1:]] - total[self.limits[:-1]]


class BallTree:
    """Tree over ``terms`` and ``impacts`` of vectors that begin at ``limits``; none is empty."""

    def __init__(self, limits: np.ndarray, terms: np.ndarray, impacts: np.ndarray, queries: Queries, n_terms: int):
        self.queries = queries
        self.values = impacts.astype(float)
        self.dense = np.zeros(n_terms)
        order = np.arange(len(limits) - 1)
        square = np.add.reduceat(self.values**2, limits[:-1]) if len(order) else np.empty(0)
        self.children: list[tuple[int, int] | None] = []
        self.spans: list[tuple[int, int]] = []
        centre, radius, parts = [], [], []
        todo = [(0, len(order), -1, 0)] if len(order) else []
        while todo:
            lo, hi, parent, side = todo.pop()
            node = len(self.spans)
            if parent >= 0:
                self.children[parent][side] = node
            mine = order[lo:hi]
            size = limits[mine + 1] - limits[mine]
            at = ragged(limits[mine], size)
            here = (terms[at], self.values[at], np.cumsum(size) - size)
            stats = self._ball(*here, size, square[mine])
            for held, new in zip((centre, radius, parts), stats):
                held.append(new)
            self.spans.append((lo, hi))
            self.children.append(None)
            if hi - lo > LEAF:
                order[lo:hi] = mine[self._halves(*here, size, square[mine])]
                middle = (lo + hi) // 2
                self.children[node] = [0, 0]
                todo += [(lo, middle, node, 0), (middle, hi, node, 1)]
        size = limits[order + 1] - limits[order]
        at = ragged(limits[order], size)
        self.order, self.terms, self.impacts = order, terms[at], impacts[at]
        self.limits = np.concatenate(([0], np.cumsum(size)))
        self.bounds = self._bounds(np.array(centre), np.array(radius), np.array(parts)) if centre else np.empty((0, len(queries.sizes)))

    def _ball(self, terms, values, starts, size, square) -> tuple[np.ndarray, float, np.ndarray]:
        """Products of the queries with the centroid, radius, and radius within each group."""
        dense, n = self.dense, len(size)
        held, place = np.unique(terms, return_inverse=True)
        dense[held] = np.bincount(place, values) / n
        products = self.queries.products(dense)
        centre, group = dense[held] ** 2, self.queries.group
        inner = values * dense[terms]
        norm, norms = centre.sum(), np.bincount(group[held], centre, GROUPS)
        cell = np.repeat(np.arange(n), size) * GROUPS + group[terms]
        far = np.bincount(cell, values**2 - 2 * inner, n * GROUPS).reshape(n, GROUPS)
        scale = square.max() + norm
        parts = np.sqrt(np.maximum((far + norms).max(axis=0), 0) + SLACK * scale)
        parts[np.bincount(group[terms], minlength=GROUPS) == 0] = 0.0  # no vector of the node has such a term
        whole = np.sqrt(max(float((square - 2 * np.add.reduceat(inner, starts) + norm).max()), 0) + SLACK * scale)
        dense[held] = 0.0
        return products, whole, parts

    def _halves(self, terms, values, starts, size, square) -> np.ndarray:
        """Members nearer to one of two distant vectors first, the others after them."""

        def distances(one: int) -> np.ndarray:
            mine = slice(starts[one], starts[one] + size[one])
            self.dense[terms[mine]] = values[mine]
            inner = np.add.reduceat(values * self.dense[terms], starts)
            self.dense[terms[mine]] = 0.0
            return square - 2 * inner + square[one]

        left = int(distances(0).argmax())
        from_left = distances(left)
        lean = from_left - distances(int(from_left.argmax()))
        return np.argsort(lean, kind="stable")

    def _bounds(self, centre: np.ndarray, radius: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """Rounded up: the most that any vector of a node can have, by node and query."""
        whole = radius[:, None] * np.sqrt(self.queries.sizes)
        away = np.minimum(whole, parts @ self.queries.parts.T)
        return (centre + away) * (1 + SLACK) + 1.0

    def search(self, query: int, mask: np.ndarray, best: Best) -> int:
        """Offer every vector that can count to ``best``; ``mask`` marks the query's terms.

        Nodes come by falling bound; the first under the least score that counts ends the
        search. Leaves are scored in 64-bit integers. Returns how many leaves were.
        """
        if not self.spans:
            return 0
        bounds, seen = self.bounds[:, query], 0
        queue = [(-bounds[0], 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            if -bound < best.least:
                break
            if self.children[node] is not None:
                for child in self.children[node]:
                    if bounds[child] >= best.least:
                        heapq.heappush(queue, (-bounds[child], child))
                continue
            seen += 1
            lo, hi = self.spans[node]
            a, b = self.limits[lo], self.limits[hi]
            scores = np.add.reduceat(self.impacts[a:b] * mask[self.terms[a:b]], self.limits[lo:hi] - a)
            best.offer(scores, self.order[lo:hi])
        return seen


class Best:
    """The highest scores of a query so far, equal ones by the least id."""

    def __init__(self, count: int):
        self.count, self.least = count, 1
        self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)
        self.names = np.empty(0, np.int64)

    def offer(self, scores: np.ndarray, rows: np.ndarray) -> None:
        good = np.flatnonzero(scores >= self.least)
        if not len(good):
            return
        scores = np.concatenate((self.scores, scores[good]))
        ids = np.concatenate((self.ids, self.names[rows[good]]))
        top = np.lexsort((ids, -scores))[: self.count]
        self.scores, self.ids = scores[top], ids[top]
        if len(top) == self.count:
            self.least = int(self.scores[-1])
