"""A compressed full-text index of short records over a large alphabet, and backward search in it.

A record is a text of a fixed number of columns; equal values in different columns
are different symbols, so the suffixes that begin in one column lie together in the
suffix array, and the index is kept column by column. Of each suffix it holds the
place of the next longer column's suffix (the function psi of compressed suffix
arrays, which rises within a symbol, so that bisection answers how often a symbol
occurs in a range of the transform), in two bytes while a shard has at most 65,536
records; and of every SAMPLED-th column the records themselves, to which other
columns walk. Neither the text nor the suffix array is kept.

A query is searched from right to left. A range of suffixes is extended by one
symbol at a time; what drops out of it cannot be extended, and is a maximal match
if it could not have begun further to the right either.
"""

from __future__ import annotations

import numpy as np

SAMPLED = 5


def paths(pieces: int) -> list[list[int]]:
    """Orders of an even number of pieces such that any two stand side by side in exactly one of them.

    The complete graph falls into zigzag paths, each turned on by one.
    """
    zigzag = [0] + [d for k in range(1, pieces // 2 + 1) for d in (k, -k)][: pieces - 1]
    return [[(start + d) % pieces for d in zigzag] for start in range(pieces // 2)]


def expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place) of all places of the ranges [lo, hi)."""
    k = np.maximum(hi - lo, 0)
    owner = np.repeat(np.arange(len(k)), k)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(lo, k)


class FMIndex:
    """Index of the texts ``codes`` (n, columns), of the records ``rows``; the codes of column j are below ``sizes[j]``."""

    def __init__(self, codes: np.ndarray, sizes: list[int], rows: np.ndarray):
        n, self.width = codes.shape
        self.n = n
        small = np.uint16 if n <= 1 << 16 else np.uint32
        self.first: list = [None] * self.width
        self.psi: list = [None] * self.width
        self.records: list = [None] * self.width
        rank = None
        for j in range(self.width - 1, -1, -1):
            code = codes[:, j]
            order = np.argsort(code, kind="stable") if rank is None else np.lexsort((rank, code))
            if rank is not None:
                self.psi[j] = rank[order].astype(small)
            if j % SAMPLED == 0 or j == self.width - 1:
                self.records[j] = rows[order].astype(np.uint32)
            self.first[j] = np.r_[0, np.cumsum(np.bincount(code, minlength=sizes[j]))].astype(np.uint32)
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.arange(n)

    def _before(self, j: int, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Places of suffixes from column j with ``symbol`` whose rest comes before ``place``: the end of them, by bisection."""
        lo, hi = self.first[j][symbol].astype(np.int64), self.first[j][symbol + 1].astype(np.int64)
        psi = self.psi[j]
        while len(at := np.flatnonzero(lo < hi)):
            mid = (lo[at] + hi[at]) >> 1
            less = psi[mid] < place[at]
            lo[at[less]], hi[at[~less]] = mid[less] + 1, mid[~less]
        return lo

    def step(self, j: int, symbol: np.ndarray, sp: np.ndarray, ep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward step: suffixes from column j that begin with ``symbol`` and go on within [sp, ep) of column j + 1."""
        return self._before(j, symbol, sp), self._before(j, symbol, ep)

    def locate(self, j: int, place: np.ndarray) -> np.ndarray:
        """Records of suffixes from column j."""
        while self.records[j] is None:
            place, j = self.psi[j][place], j + 1
        return self.records[j][place].astype(np.int64)

    def maximal_matches(self, codes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, record, first column, last column) of the maximal matches of ``least`` or more symbols.

        ``codes``: queries in the index's codes, -1 where no record has the symbol.
        Each match is of one record and can be extended with it neither to the left
        nor to the right.
        """
        queries, found = len(codes), []
        longer = np.zeros((self.width, 2, queries), dtype=np.int64)  # by first column: the ranges that end one column further on
        for last in range(self.width - 1, least - 2, -1):
            ranges = np.zeros_like(longer)
            q = np.flatnonzero(codes[:, last] >= 0)
            symbol, j = codes[q, last], last
            sp, ep = self.first[last][symbol].astype(np.int64), self.first[last][symbol + 1].astype(np.int64)
            while len(q):
                ranges[j, 0, q], ranges[j, 1, q] = sp, ep
                symbol = codes[q, j - 1] if j else np.full(len(q), -1)
                nsp, nep = np.zeros(len(q), dtype=np.int64), np.zeros(len(q), dtype=np.int64)
                if len(known := np.flatnonzero(symbol >= 0)):
                    nsp[known], nep[known] = self.step(j - 1, symbol[known], sp[known], ep[known])
                if last - j + 1 >= least:
                    found.append(self._emit(j, last, q, (sp, ep), longer[j][:, q], (nsp, nep)))
                grows = nsp < nep
                q, sp, ep, j = q[grows], nsp[grows], nep[grows], j - 1
            longer = ranges
        none = np.zeros(0, dtype=np.int64)
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (none, none, none, none)

    def _emit(self, j: int, last: int, q: np.ndarray, here: tuple, right: np.ndarray, left: tuple) -> tuple:
        """Matches [j, last] of the suffixes ``here`` without those that go on to the ``right`` or ``left``."""
        sp, ep = here
        on = right[0] < right[1]
        a, p = expand(sp, np.where(on, right[0], ep))
        b, r = expand(np.where(on, right[1], ep), ep)
        owner, place = np.r_[a, b], np.r_[p, r]
        if len(place) and (left[0] < left[1]).any():
            c, before = expand(*left)
            stays = ~np.isin(owner * self.n + place, c * self.n + self.psi[j - 1][before].astype(np.int64))
            owner, place = owner[stays], place[stays]
        return q[owner], self.locate(j, place), np.full(len(place), j), np.full(len(place), last)


def merged(query: np.ndarray, record: np.ndarray, mask: np.ndarray, records: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, record, mask) once for each pair: the union of its spans, which are given as bits."""
    if not len(query):
        return query, record, mask
    pair = query * records + record
    order = np.argsort(pair, kind="stable")
    pair = pair[order]
    at = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    return pair[at] // records, pair[at] % records, np.bitwise_or.reduceat(mask[order], at)
