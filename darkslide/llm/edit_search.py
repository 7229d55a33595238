"""Windows of texts within a few word edits of windows of given passages.

A window is embedded by a random walk: a table of random bits decides, by the
step and the word at hand, whether to go on to the next word, and each step puts
out the word it looks at. Windows at small edit distance take walks that soon
meet again, so their outputs differ in few places; equal windows have equal
outputs. A sample of the output's places is a hash. How often one walk and sample
bring together windows that are as many edits apart as allowed is measured on the
passages themselves, and as many tables are made as the recall asked for needs.
Windows that share a hash are verified by their exact edit distance.

Equal windows meet in every table, so matches without an edit are never missed.
"""

from __future__ import annotations

import math

import numpy as np

from darkslide.llm.words import words

#: Windows, at most, and tables by which the meeting of edited windows is measured.
PROBES, PROBE_TABLES = 400, 24


class EditSearch:
    """``passages``: (id, text). ``size``: words of a window; ``edits``: allowed word edits; ``recall``: of windows at that many edits."""

    def __init__(self, passages: list[tuple[int, str | None]], size: int, edits: int = 2, recall: float = 0.9, sample: int = 8, seed: int = 1):
        self.size, self.edits = size, edits
        self.vocabulary: dict[str, int] = {}
        owners, windows = [], []
        for i, text in passages:
            symbols = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)], dtype=np.int32)
            if len(symbols) >= size:
                view = np.lib.stride_tricks.sliding_window_view(symbols, size)
                windows.append(view)
                owners += [i] * len(view)
        all_windows = np.concatenate(windows) if windows else np.zeros((0, size), np.int32)
        owners_array = np.array(owners, dtype=np.int64)
        # A window that several passages have is one window with several owners.
        self.windows, inverse = np.unique(all_windows, axis=0, return_inverse=True) if len(all_windows) else (all_windows, np.zeros(0, int))
        order = np.argsort(inverse, kind="stable")
        self.owners = owners_array[order]
        self.owned = np.searchsorted(inverse[order], np.arange(len(self.windows) + 1))
        self.rng = np.random.default_rng(seed)
        self.walks: list[tuple] = []
        self._more_walks(PROBE_TABLES, min(sample, 3 * size))
        self.rate = self._meeting_rate()
        #: Tables by which windows at ``edits`` edits meet with the recall asked for.
        self.tables = math.ceil(math.log(1 - recall) / math.log(1 - self.rate)) if 0 < self.rate < 1 else 1
        self._more_walks(self.tables - len(self.walks), min(sample, 3 * size))
        del self.walks[self.tables :]
        self.index = []
        for walk in self.walks:
            h = self._hash(self.windows, walk)
            at = np.argsort(h, kind="stable").astype(np.int32)
            self.index.append((h[at], at))

    def _more_walks(self, n: int, sample: int) -> None:
        steps = 3 * self.size
        for _ in range(n):
            bits = self.rng.integers(0, 2, (steps, len(self.vocabulary) + 1), dtype=np.int8)
            places = np.sort(self.rng.choice(steps, sample, replace=False))
            mix = self.rng.integers(1, 1 << 62, steps, dtype=np.uint64) | np.uint64(1)
            self.walks.append((bits[: places[-1] + 1], frozenset(places.tolist()), mix))

    def _meeting_rate(self) -> float:
        """How often a table brings together a window and one that is ``edits`` edits away."""
        if not self.edits or not len(self.windows):
            return 1.0
        some = self.windows[self.rng.integers(0, len(self.windows), min(PROBES, len(self.windows)))]
        other = []
        for w in some.tolist():
            for _ in range(self.edits):
                kind, at, word = self.rng.integers(3), self.rng.integers(self.size), int(self.rng.integers(1, len(self.vocabulary) + 1))
                if kind == 0:
                    w = [*w[:at], word, *w[at + 1 :]]
                elif kind == 1:
                    w = [*w[:at], *w[at + 1 :], word]
                else:
                    w = [*w[:at], word, *w[at:-1]]
            other.append(w)
        other = np.array(other, dtype=np.int32)
        return float(np.mean([(self._hash(some, w) == self._hash(other, w)).mean() for w in self.walks]))

    def _hash(self, windows: np.ndarray, walk: tuple) -> np.ndarray:
        """The sampled places of the walk's output, mixed to 64 bits."""
        bits, wanted, mix = walk
        n = len(windows)
        flat = np.concatenate([windows, np.full((n, 1), -1, windows.dtype)], axis=1).ravel()
        start = np.arange(n, dtype=np.int64) * (self.size + 1)
        place, end, out = start.copy(), start + self.size, np.zeros(n, dtype=np.uint64)
        for j in range(len(bits)):
            word = flat[place]
            if j in wanted:
                x = (word.astype(np.int64) + 2).astype(np.uint64) * mix[j]
                out = (out ^ (x ^ (x >> np.uint64(29)))) * np.uint64(0x9E3779B97F4A7C15)
            place = np.minimum(place + bits[j][np.maximum(word, 0)], end)
        return out

    def find(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in texts, passage id, edits) of each text and passage that have windows within ``edits`` of each other, with the fewest edits.

        Texts are searched whole; null, empty and short ones match nothing.
        """
        none = np.zeros(0, dtype=np.int64)
        if not len(self.windows):
            return none, none, none
        know, symbols, lengths = self.vocabulary.get, [], []
        for text in texts:
            w = [know(x, 0) for x in words(text)]
            lengths.append(len(w))
            symbols += w
        symbols = np.array(symbols, dtype=np.int32)
        if len(symbols) < self.size:
            return none, none, none
        text_of = np.repeat(np.arange(len(lengths)), lengths)
        # A word that no passage has costs an edit, so windows with more of them are out.
        unknown = np.r_[0, np.cumsum(symbols == 0)]
        at = np.flatnonzero((unknown[self.size :] - unknown[: -self.size] <= self.edits) & (text_of[: len(symbols) - self.size + 1] == text_of[self.size - 1 :]))
        if not len(at):
            return none, none, none
        mine, inverse = np.unique(np.lib.stride_tricks.sliding_window_view(symbols, self.size)[at], axis=0, return_inverse=True)
        pairs = []
        for walk, (hashes, owner) in zip(self.walks, self.index):
            h = self._hash(mine, walk)
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            k = hi - lo
            row = np.repeat(np.arange(len(mine)), k)
            place = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(lo, k)
            pairs.append(row * len(self.windows) + owner[place])
        pair = np.unique(np.concatenate(pairs))
        row, window = pair // len(self.windows), pair % len(self.windows)
        far = edit_distances(mine[row], self.windows[window], self.edits)
        near = far <= self.edits
        row, window, far = row[near], window[near], far[near]
        # From pairs of different windows to the texts and the passages that have them.
        order = np.argsort(inverse.ravel(), kind="stable")
        begin = np.searchsorted(inverse.ravel()[order], np.arange(len(mine) + 1))
        k = begin[row + 1] - begin[row]
        who = np.repeat(np.arange(len(row)), k)
        text = text_of[at[order[np.arange(len(who)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(begin[row], k)]]]
        k = (self.owned[window + 1] - self.owned[window])[who]
        twice = np.repeat(np.arange(len(who)), k)
        passage = self.owners[np.arange(len(twice)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(self.owned[window[who]], k)]
        text, far = text[twice], far[who[twice]]
        order = np.lexsort((far, passage, text))
        text, passage, far = text[order], passage[order], far[order]
        first = np.r_[True, (text[1:] != text[:-1]) | (passage[1:] != passage[:-1])] if len(text) else np.zeros(0, bool)
        return text[first], passage[first], far[first]


def edit_distances(a: np.ndarray, b: np.ndarray, edits: int) -> np.ndarray:
    """Edit distances of pairs of word windows, where above ``edits`` just something above; an unknown word (0) equals none."""
    n, size = a.shape
    out = np.where(((a == b) & (a != 0)).all(axis=1), 0, edits + 1)
    left = np.flatnonzero(out > edits) if edits else np.zeros(0, dtype=np.int64)
    a, b = a[left].T, b[left].T
    row = [np.full(len(left), j, dtype=np.int16) for j in range(size + 1)]
    far = np.full(len(left), edits + 1, dtype=np.int16)
    for i in range(1, size + 1):
        # Cells further than ``edits`` from the diagonal cannot come back.
        lo, hi = max(1, i - edits), min(size, i + edits)
        new = [far] * (size + 1)
        if lo == 1:
            new[0] = np.full(len(left), i, dtype=np.int16)
        for j in range(lo, hi + 1):
            differs = ((a[i - 1] != b[j - 1]) | (a[i - 1] == 0)).astype(np.int16)
            new[j] = np.minimum(np.minimum(row[j], new[j - 1]) + 1, row[j - 1] + differs)
        row = new
    out[left] = np.minimum(row[size], edits + 1)
    return out
