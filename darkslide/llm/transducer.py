"""Byte-pair encoding as a lazily determinised finite-state transducer.

A sequence of tokens is the encoding of its bytes exactly if every token is the
encoding of its own bytes and every two neighbours are the encoding of theirs.
So the encoding of a prefix plus one byte is that of some shorter prefix plus
one token, and only prefixes from which the bytes since then still begin some
token matter. A state is that set: places in the vocabulary's prefix tree, each
with the tokens decided on that path but not yet emitted. Reading a byte moves
all of them; tokens that all of them have in common are emitted, at most the
length of the longest token behind the reader. States and moves are made when
they are first needed and kept.

Decoding is a stream too: bytes of tokens run through a state machine of UTF-8
that emits whole characters.
"""

from __future__ import annotations

import base64

import regex

# Fixed value: the pattern that cuts texts into pieces which merges never cross.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Memory bounds: beyond so many moves or pieces, what is kept is dropped and made anew.
MAX_MOVES, MAX_PIECES = 1_000_000, 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ids of a file with a base64 token and an id in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.tokens = ranks, {i: t for t, i in ranks.items()}
        self._node: dict[int, int] = {}  # node * 256 + byte -> node of the prefix tree; the root is 0
        self._token: list[int] = [-1]
        self._inner: list[bool] = [False]
        for token, i in ranks.items():
            at = 0
            for byte in token:
                self._inner[at] = True
                key = at * 256 + byte
                if key not in self._node:
                    self._node[key] = len(self._token)
                    self._token.append(-1)
                    self._inner.append(False)
                at = self._node[key]
            self._token[at] = i
        self._own: dict[int, bool] = {}
        self._pair: dict[tuple[int, int], bool] = {}
        self._pieces: dict[str, list[int]] = {}
        self._cut = regex.compile(PIECES).findall
        self._forget()

    def _forget(self) -> None:
        start = (-1, ((0, ()),))
        self._states, self._ids, self._moves = [start], {start: 0}, {}

    def merge(self, text: bytes) -> list[int]:
        """Plain merging, lowest rank first; used to find out which tokens and neighbours are encodings."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if rank == 1 << 40:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _fits(self, before: int, token: int) -> bool:
        ok = self._own.get(token)
        if ok is None:
            ok = self._own[token] = self.merge(self.tokens[token]) == [token]
        if not ok or before < 0:
            return ok
        key = (before, token)
        ok = self._pair.get(key)
        if ok is None:
            if len(self._pair) > MAX_MOVES:
                self._pair.clear()
            ok = self._pair[key] = self.merge(self.tokens[before] + self.tokens[token]) == [before, token]
        return ok

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        before, places = self._states[state]
        live, path = [], None
        for node, pending in places:
            to = self._node.get(node * 256 + byte)
            if to is None:
                continue
            token = self._token[to]
            if token >= 0 and path is None and self._fits(pending[-1] if pending else before, token):
                path = (*pending, token)
            if self._inner[to]:
                live.append((to, pending))
        if path is None:
            raise ValueError(f"no token for byte {byte}")
        live.append((0, path))
        n = 0
        first = live[0][1]
        while n < len(first) and all(len(p) > n and p[n] == first[n] for _, p in live):
            n += 1
        if n:
            before = first[n - 1]
            live = [(node, p[n:]) for node, p in live]
        new = (before if any(not p for _, p in live) else -1, tuple(live))
        at = self._ids.get(new)
        if at is None:
            at = self._ids[new] = len(self._states)
            self._states.append(new)
        return at, first[:n]

    def encode_bytes(self, text: bytes) -> list[int]:
        out: list[int] = []
        state, moves = 0, self._moves
        for byte in text:
            move = moves.get(state * 256 + byte)
            if move is None:
                move = moves[state * 256 + byte] = self._move(state, byte)
            state = move[0]
            if move[1]:
                out.extend(move[1])
        out.extend(self._states[state][1][-1][1])
        if len(moves) > MAX_MOVES:
            self._forget()
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens; none for a null or empty text. Strings of special tokens are ordinary text."""
        if not text:
            return []
        out: list[int] = []
        known = self._pieces
        for piece in self._cut(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.encode_bytes(piece.encode())
                if len(piece) <= 64:
                    if len(known) >= MAX_PIECES:
                        known.clear()
                    known[piece] = ids
            out.extend(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        stream = Utf8Stream()
        return "".join([stream.feed(self.tokens[i]) for i in ids]) + stream.end()


class Utf8Stream:
    """Bytes in, whole characters out; U+FFFD for each maximal part that is no character."""

    def __init__(self) -> None:
        self._held, self._need, self._lo, self._hi = bytearray(), 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        if not self._need and data.isascii():
            return data.decode("ascii")
        out = []
        for b in data:
            if self._need:
                if self._lo <= b <= self._hi:
                    self._held.append(b)
                    self._need -= 1
                    self._lo, self._hi = 0x80, 0xBF
                    if not self._need:
                        out.append(self._held.decode())
                        self._held.clear()
                    continue
                out.append("�")
                self._held.clear()
                self._need, self._lo, self._hi = 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xF4:
                self._need = 1 if b < 0xE0 else 2 if b < 0xF0 else 3
                self._lo = 0xA0 if b == 0xE0 else 0x90 if b == 0xF0 else 0x80
                self._hi = 0x9F if b == 0xED else 0x8F if b == 0xF4 else 0xBF
                self._held.append(b)
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        return "�" if self._need else ""
