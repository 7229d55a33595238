"""Vantage-point trees over unit vectors.

A node has a vantage point and the median of its vectors' distances to it; what
is nearer goes inside, the rest outside. A search that has found k vectors within
r of the query needs a child only if the triangle inequality lets it hold
something nearer. ``factor`` relaxes that: the search acts as if it had r / factor
already. Factor one is exact; a larger one skips more and may miss some.

Everything works on batches of queries, and leaves are compared by one matrix
product in single precision. What single precision cannot order is compared again
in double precision.
"""

from __future__ import annotations

import numpy as np

#: Candidates kept beyond k in single precision, before they are ranked in double precision.
SPARE = 3
#: More than what a cosine in single precision can be wrong by.
EPS = 5e-6


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision."""
    v = vectors.astype(np.float64)
    # Extreme values would overflow or vanish when squared.
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def distances(a: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ point), 0))


class Router:
    """The top of the tree, made from a sample: which shard a vector lies in, and which shards a search visits.

    ``wanted``: shards to make; the sample has to hold eight vectors for each, or there
    are fewer. A leaf can be split further by a router of its own (``refine``); a leaf
    whose vectors no vantage point tells apart can be cut into parts by ``key``.
    """

    def __init__(self, sample: np.ndarray, wanted: int, seed: int = 1):
        self.depth = max(0, int(np.ceil(np.log2(max(1, wanted)))))
        while self.depth and 2**self.depth * 8 > len(sample):
            self.depth -= 1
        n = 2**self.depth - 1
        dim = sample.shape[1] if len(sample) else 1
        self.points, self.medians = np.zeros((n, dim)), np.zeros(n)
        rng = np.random.default_rng(seed)
        parts = {0: sample}
        for node in range(n):
            part = parts.pop(node)
            p = spread_point(part, rng) if len(part) else np.ones(dim) / np.sqrt(dim)
            d = distances(part, p)
            m = float(np.median(d)) if len(d) else 1.0
            self.points[node], self.medians[node] = p, m
            parts[2 * node + 1], parts[2 * node + 2] = part[d <= m], part[d > m]
        self.first_leaf = n
        #: Share of the sample in each leaf, routers of leaves, and parts of leaves that have none.
        self.shares = np.array([len(parts[n + i]) for i in range(n + 1)]) / max(1, len(sample))
        self.inner: dict[int, Router] = {}
        self.parts = np.ones(n + 1, dtype=np.int64)

    def refine(self, inner: dict[int, Router]) -> None:
        self.inner = inner

    def cut(self, total: float, largest: int) -> None:
        """Cut leaves of which the sample says that they hold more than ``largest`` of ``total`` vectors."""
        for i, share in enumerate(self.shares):
            if i in self.inner:
                self.inner[i].cut(total * share, largest)
            else:
                self.parts[i] = max(1, int(np.ceil(total * share / largest)))

    @property
    def base(self) -> np.ndarray:
        """Number of the first shard of each leaf, and of all shards at the end."""
        return np.r_[0, np.cumsum([self.inner[i].base[-1] if i in self.inner else p for i, p in enumerate(self.parts)])]

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(self.depth):
            d = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", x, self.points[node]), 0))
            node = 2 * node + 1 + (d > self.medians[node])
        return node - self.first_leaf

    def home(self, x: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The shard of each vector; ``key``: some number of each, by which leaves are cut into parts."""
        leaf, base = self.leaf(x), self.base
        mixed = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        out = base[leaf] + (mixed % self.parts[leaf].astype(np.uint64)).astype(np.int64)
        for i, router in self.inner.items():
            at = np.flatnonzero(leaf == i)
            out[at] = base[i] + router.home(x[at], key[at])
        return out

    def visits(self, x: np.ndarray, r: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, shard) pairs of all shards that may hold something within r / factor."""
        reach, base = r / factor + 1e-6, self.base
        rows, shards = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def visit(node: int, row: np.ndarray) -> None:
            """Node by node, as all pairs of a vector and a node at once would take their number times the length of a vector."""
            leaf = node - self.first_leaf
            if not len(row):
                return
            if leaf in self.inner:
                a, b = self.inner[leaf].visits(x[row], r[row], factor)
                rows.append(row[a])
                shards.append(base[leaf] + b)
            elif leaf >= 0:
                rows.extend([row] * self.parts[leaf])
                shards.extend(np.full(len(row), base[leaf] + part) for part in range(self.parts[leaf]))
            else:
                d = distances(x[row], self.points[node])
                visit(2 * node + 1, row[d - reach[row] <= self.medians[node]])
                visit(2 * node + 2, row[d + reach[row] > self.medians[node]])

        visit(0, np.arange(len(x)))
        return np.concatenate(rows), np.concatenate(shards)


def spread_point(x: np.ndarray, rng: np.random.Generator, tries: int = 8, sample: int = 256) -> np.ndarray:
    """Of a few vectors the one whose distances to some others differ most."""
    some = x[rng.integers(0, len(x), min(sample, len(x)))]
    options = x[rng.integers(0, len(x), min(tries, len(x)))]
    d = np.sqrt(np.maximum(2 - 2 * (options @ some.T), 0))
    return options[np.argmax(d.std(axis=1))]


class VPTree:
    """A tree over ``raw`` vectors in single precision; ``rank`` orders equally similar ones. It can be pickled; places are those in ``raw``."""

    def __init__(self, raw: np.ndarray, rank: np.ndarray, leaf: int = 256, seed: int = 1):
        x, self.order = unit(raw), np.arange(len(raw))
        rng = np.random.default_rng(seed)

        def build(lo: int, hi: int):
            if hi - lo <= leaf:
                return lo, hi
            at = self.order[lo:hi]
            p = spread_point(x[at], rng)
            d = distances(x[at], p)
            m = float(np.median(d))
            inside = d <= m
            mid = lo + int(inside.sum())
            if mid == hi or mid == lo:
                return lo, hi
            self.order[lo:hi] = np.r_[at[inside], at[~inside]]
            return p, m, build(lo, mid), build(mid, hi)

        self.root = build(0, len(raw))
        self.__setstate__((raw[self.order], rank[self.order], self.order, self.root))

    def __getstate__(self) -> tuple:
        return self.raw, self.rank, self.order, self.root

    def __setstate__(self, state: tuple) -> None:
        self.raw, self.rank, self.order, self.root = state
        self.x = unit(self.raw)
        self.single = self.x.astype(np.float32)
        self.place = np.empty(len(self.order), dtype=np.int64)
        self.place[self.order] = np.arange(len(self.order))

    def search(self, q: np.ndarray, k: int, factor: float, within: np.ndarray | None = None, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(places or -1, similarities) of the k nearest of each unit vector of ``q``, nearest first, then by rank.

        ``within``: distances that are already reached otherwise. ``own``: for each
        query its own place, which does not count.
        """
        n, keep = len(q), k + SPARE
        best, where = np.full((n, keep), -2.0, np.float32), np.full((n, keep), -1, np.int64)
        single = q.astype(np.float32)
        limit = np.full(n, -2.0, np.float32) if within is None else (1 - within.astype(np.float64) ** 2 / 2 - EPS).astype(np.float32)
        mine = None if own is None else self.place[own]

        def radius(rows: np.ndarray) -> np.ndarray:
            s = np.maximum(best[rows, k - 1].astype(np.float64) - EPS, limit[rows])
            return np.sqrt(np.maximum(2 - 2 * s, 0)) / factor + 1e-6

        def compare(rows: np.ndarray, lo: int, hi: int) -> np.ndarray:
            s = single[rows] @ self.single[lo:hi].T
            if mine is not None:
                here = np.flatnonzero((mine[rows] >= lo) & (mine[rows] < hi))
                s[here, mine[rows[here]] - lo] = -2.0
            return s

        def visit(node, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if len(node) == 2:
                lo, hi = node
                s = compare(rows, lo, hi)
                some = s.max(axis=1) > np.maximum(best[rows, -1], limit[rows])
                if some.any():
                    rows, s = rows[some], s[some]
                    if s.shape[1] > keep:
                        top = np.argpartition(s, s.shape[1] - keep, axis=1)[:, -keep:]
                        s, at = np.take_along_axis(s, top, 1), top + lo
                    else:
                        at = np.broadcast_to(np.arange(lo, hi), s.shape)
                    s, at = np.concatenate([best[rows], s], axis=1), np.concatenate([where[rows], at], axis=1)
                    order = np.argsort(-s, axis=1, kind="stable")[:, :keep]
                    best[rows], where[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(at, order, 1)
                return
            point, median, inside, outside = node
            d = distances(q[rows], point)
            near = d <= median
            a, b, da, db = rows[near], rows[~near], d[near], d[~near]
            visit(inside, a)
            visit(outside, b)
            visit(outside, a[da + radius(a) > median])
            visit(inside, b[db - radius(b) <= median])

        if len(self.x):
            visit(self.root, np.arange(n))
        exact = np.where(where >= 0, np.einsum("ij,ikj->ik", q, self.x[np.maximum(where, 0)]), -2.0) if len(self.x) else np.full((n, keep), -2.0)
        where[exact <= -2.0] = -1
        rank = np.where(where >= 0, self.rank[np.maximum(where, 0)], np.iinfo(np.int64).max) if len(self.x) else where
        order = np.lexsort((rank, -exact), axis=1)[:, :k]
        places, sims = np.take_along_axis(where, order, 1), np.take_along_axis(exact, order, 1)
        # Where more vectors than were kept may be as near as the k-th, all that may be are ranked.
        tight = np.flatnonzero((where[:, -1] >= 0) & (best[:, -1] >= best[:, k - 1] - 2 * EPS))
        for at in range(0, len(tight), 512):
            rows = tight[at : at + 512]
            s = compare(rows, 0, len(self.x))
            row, col = np.nonzero(s >= (best[rows, k - 1] - 2 * EPS)[:, None])
            for begin in range(0, len(rows), 64):
                sel = (row >= begin) & (row < begin + 64)
                r, c = row[sel], col[sel]
                sim = np.einsum("ij,ij->i", q[rows[r]], self.x[c])
                o = np.lexsort((self.rank[c], -sim, r))
                r, c, sim = r[o], c[o], sim[o]
                nth = np.arange(len(r)) - np.searchsorted(r, r)
                top = nth < k
                places[rows[r[top]], nth[top]], sims[rows[r[top]], nth[top]] = c[top], sim[top]
        return np.where(places >= 0, self.order[np.maximum(places, 0)], -1) if len(self.x) else places, sims
