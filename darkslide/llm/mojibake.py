"""Text that was decoded with a wrong encoding: finding it and undoing it.

Characters are mapped back to the bytes that a legacy encoding would have made
them from. A byte-structure automaton, that of well-formed UTF-8, then finds the
maximal spans of whole multibyte characters, and only those spans are decoded.
Spans whose characters could stand side by side in sound text count only next to
others that could not. The result may be damaged in the same way again, so this
is repeated until nothing more is found.

Single-byte encodings taken for each other leave no multibyte structure. There the
letter pairs of a word tell: ``Pairs`` counts those of all texts, and a word is
read anew where another reading has far commoner ones. Replacement characters mark
stretches that nothing can restore.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Encodings that UTF-8 bytes are taken for. C1 controls stand for bytes an encoding leaves open.
CODECS = ("cp1252", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "cp866", "iso8859_2")

_SEQUENCE = rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}"
_ONE = re.compile(_SEQUENCE)
_SPAN = re.compile(rb"(?:" + _SEQUENCE + rb")+")
_RUSSIAN = set("абвгдежзийклмнопрстуфхцчшщъыьэюяёАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁ")
_MARKS = set("»”’“‘„‚…—–·•«›‹")
#: How punctuation begins in encodings that have letters or quotes for its first two bytes.
_PUNCTUATION_LEADS = {b"\xe2\x80".decode(c) for c in ("mac_roman", "cp437", "cp850", "cp866", "cp1251")}


class _Bytes(dict):
    """Characters to the characters of their bytes; what has no byte becomes NUL."""

    def __missing__(self, c: int) -> str:
        return "\0"


def _table(codec: str) -> _Bytes:
    t = _Bytes({c: chr(c) for c in range(128)})
    for b in range(128, 256):
        try:
            t.setdefault(ord(bytes([b]).decode(codec)), chr(b))
        except UnicodeDecodeError:
            pass
    if codec.startswith("cp125"):
        for b in range(128, 160):
            t.setdefault(b, chr(b))
    if codec == "cp1252":
        for b in range(128, 160):
            t[b] = chr(b)
    return t


_TABLES = {c: _table(c) for c in CODECS}
#: Only characters of these encodings, two or more in a row and not all Russian letters, can be damage.
_SOURCES = "".join(sorted({chr(c) for t in _TABLES.values() for c in t if c > 127}))
_SUSPECT = re.compile(f"[{re.escape(_SOURCES)}]{{2,}}")
_SOUND = re.compile("[А-яЁё]+")
#: Letters in an order that sound words do not have.
_LEAD = re.compile("[а-яё][А-ЯЁ]")

# Ranges of characters that texts are likely to hold.
_LIKELY = (
    (0xA0, 0x17F), (0x192, 0x192), (0x2C6, 0x2DD), (0x391, 0x3C9), (0x400, 0x45F), (0x490, 0x491), (0x2010, 0x2044), (0x20AC, 0x20AC),
    (0x2116, 0x2122), (0x2190, 0x22FF), (0x2310, 0x2320), (0x2500, 0x27BF), (0x3000, 0x30FF), (0x4E00, 0x9FFF), (0xFB01, 0xFB02), (0xFE0F, 0xFE0F),
    (0xFEFF, 0xFEFF), (0xFF01, 0xFFEF), (0xFFFD, 0xFFFD), (0x1F000, 0x1FAFF),
)
#: Ranges that count only in runs, since a single such character is rarely meant.
_IN_RUNS = ((0x80, 0x9F), (0x300, 0x36F), (0x5D0, 0x6FF), (0x900, 0x97F), (0xE00, 0xE7F), (0x200B, 0x200F), (0xAC00, 0xD7AF))


def _within(c: int, ranges: tuple) -> bool:
    return any(a <= c <= b for a, b in ranges)


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    text: str


def _telling(source: str, before: str) -> bool:
    """Whether sound text would not have these characters in a row."""
    if source[0].isupper() and before.islower():
        return True
    if len(source) == 3 and source[:2] in _PUNCTUATION_LEADS:
        return True
    if all(c in _RUSSIAN for c in source):
        return False
    if all(c.isalpha() or c in _MARKS for c in source):
        # An accented letter beside a quote, or letters of one case; a small letter after capitals is fine too.
        latin_pair = len(source) == 2 and source[0] in "ÂÃÄÅĂĹÐÑ" and source[1].isalpha() and source[1].islower()
        return latin_pair or sum(c in _MARKS for c in source) >= 2
    return True


def _runs(text: str, codec: str, sound: bool) -> list[tuple[list, int]]:
    """Runs of whole multibyte characters: their likely ones as (start, end, character), and how many of these tell.

    All bytes of such a character come from characters of ``_SOURCES``, so only runs of
    these are read; without ``sound`` those that sound text is full of are passed over.
    """
    runs = []
    for m in _SUSPECT.finditer(text):
        piece, at = m.group(), m.start()
        if not sound and _SOUND.fullmatch(piece) and not _LEAD.search(piece):
            continue
        raw = piece.translate(_TABLES[codec]).encode("latin-1")
        for run in _SPAN.finditer(raw):
            parts, telling = [], 0
            for c in _ONE.finditer(raw, run.start(), run.end()):
                char = c.group().decode("utf-8")
                source = piece[c.start() : c.end()]
                likely = _within(ord(char), _LIKELY)
                if not likely and not _within(ord(char), _IN_RUNS):
                    continue
                told = _telling(source, text[at + c.start() - 1] if at + c.start() else "")
                telling += told and (likely or len(run.group()) > len(source))
                parts.append((at + c.start(), at + c.end(), char))
            if parts:
                runs.append((parts, telling))
    return runs


def _spans(text: str, codec: str) -> list[Span]:
    if not any(telling for _, telling in _runs(text, codec, False)):
        return []
    runs, found = _runs(text, codec, True), []
    strong = [p for parts, telling in runs if telling for p in parts]
    # Beside spans that tell, spans that do not are damage as well: one letter words for example.
    starts, ends = [p[0] for p in strong], [p[1] for p in strong]

    def beside(p: tuple) -> bool:
        i = bisect_left(starts, p[1])
        return i < len(starts) and starts[i] - p[1] < 40 or i > 0 and p[0] - ends[i - 1] < 40

    for parts, telling in runs:
        if not telling and not any(map(beside, parts)):
            continue
        for p in parts:
            if found and found[-1].end == p[0]:
                found[-1] = Span(found[-1].start, p[1], found[-1].text + p[2])
            else:
                found.append(Span(*p))
    return found


def _apply(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for s in spans:
        out += [text[at : s.start], s.text]
        at = s.end
    return "".join([*out, text[at:]])


#: Single-byte encodings taken for each other: (taken for, meant).
MISTAKEN = tuple(
    (taken, meant)
    for family in (("cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic"), ("cp1252", "cp1250", "iso8859_2", "mac_roman", "cp437", "cp850", "cp852"))
    for taken in (*family, *(("cp1252", "latin_1", "mac_roman", "cp437") if family[0] == "cp1251" else ("latin_1",)))
    for meant in family
    if taken != meant
)
_HIGH = bytes(range(128, 256))
_LETTERS = "".join(map(chr, [*range(65, 91), *range(97, 123)]))
_ALPHABET = _LETTERS + "".join(sorted({c for t in {x for pair in MISTAKEN for x in pair} for c in _HIGH.decode(t, "ignore") if not c.isspace() and ord(c) > 0xA0}))
_CLASS = np.zeros(0x3000, dtype=np.int64)
_CLASS[[ord(c) for c in _ALPHABET if ord(c) < 0x3000]] = [i for i, c in enumerate(_ALPHABET, 1) if ord(c) < 0x3000]
#: Classes of characters: each of the alphabet, and 0 for all others.
CLASSES = len(_ALPHABET) + 1
_WORD = re.compile(f"[{re.escape(_ALPHABET)}]*[{re.escape(_ALPHABET[52:])}][{re.escape(_ALPHABET)}]*")
#: Words of one script.
_SCRIPT = re.compile("[A-Za-zÀ-ÖØ-öø-ſ]+|[Ѐ-ӿ]+")
_REREAD = [str.maketrans({taken: meant for byte in _HIGH for taken, meant in [(bytes([byte]).decode(a, "ignore"), bytes([byte]).decode(b, "ignore"))] if taken and meant}) for a, b in MISTAKEN]


def pairs(text: str) -> np.ndarray:
    """Numbers of the pairs of neighbours of which one is a character of the alphabet beyond ASCII."""
    c = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = _CLASS[np.where(c < 0x3000, c, 0)]
    high = c > len(_LETTERS)
    return (c[:-1] * CLASSES + c[1:])[high[:-1] | high[1:]]


class Pairs:
    """How common pairs of neighbours are: from counts by the number of the pair, over all texts."""

    #: Pairs rarer than this share make a word worth another reading.
    RARE = 1e-4
    #: A reading is taken if it makes the pairs of all its words together so many times likelier (logarithm), and those of each word LEAST.
    SURE, LEAST = 7.0, 1.5

    def __init__(self, counts: np.ndarray):
        self.log = np.log(counts + 0.5)
        self.rare = counts < self.RARE * counts.sum()
        self.readings = lru_cache(maxsize=200_000)(self._readings)

    def odd(self, text: str) -> bool:
        return bool(self.rare[pairs(text)].any())

    def _readings(self, word: str) -> tuple[tuple[int, str, float], ...]:
        """(number in MISTAKEN, word read so, gain) of the readings that make the word likelier."""
        before, out, seen = self.log[pairs(word)].sum(), [], {word}
        for i, table in enumerate(_REREAD):
            other = word.translate(table)
            if other in seen or not _SCRIPT.fullmatch(other) or len(pairs(other)) != len(pairs(word)):
                continue
            if (gain := float(self.log[pairs(other)].sum() - before)) >= self.LEAST:
                out.append((i, other, gain))
        return tuple(out)


def _single_byte(text: str, model: Pairs) -> tuple[str, list[Span]]:
    """Words of one mistaken encoding, that which gains most, read anew; nothing if the gain is not sure."""
    if not model.odd(text):
        return text, []
    found: dict[int, list] = {}
    for m in _WORD.finditer(text):
        for i, other, gain in model.readings(m.group()):
            found.setdefault(i, []).append((gain, Span(m.start(), m.end(), other)))
    if not found:
        return text, []
    # A single letter goes along with others, but does not tell.
    sure = lambda words: sum(g for g, s in words if s.end - s.start > 1)
    best = max(found.values(), key=sure)
    if sure(best) < Pairs.SURE:
        return text, []
    spans = [s for _, s in best]
    return _apply(text, spans), spans


def repair(text: str | None, model: Pairs | None = None) -> tuple[str | None, int, bool]:
    """(restored text, damaged stretches found, whether all of them are restored).

    A null, empty or sound text comes back as it is with 0 stretches. Replacement
    characters count as stretches and stay. Restored means that a last pass with the
    encodings undone finds no more characters, not even such as do not tell. Without
    ``model`` single-byte encodings taken for each other are not looked for.
    """
    if not text or text.isascii():
        return text, 0, True
    total, undone = 0, set()
    while True:  # each round makes the text shorter
        if not any(_LEAD.search(m.group()) or not _SOUND.fullmatch(m.group()) for m in _SUSPECT.finditer(text)):
            break
        best: list[Span] = []
        for codec in CODECS:
            spans = _spans(text, codec)
            if sum(s.end - s.start for s in spans) > sum(s.end - s.start for s in best):
                best, by = spans, codec
        if not best:
            break
        total += len(best)
        text = _apply(text, best)
        undone.add(by)
    while model is not None:  # each round makes the text's pairs likelier
        text, spans = _single_byte(text, model)
        if not spans:
            break
        total += len(spans)
    lost = text.count("\ufffd")
    return text, total + lost, not lost and not any(_runs(text, c, True) for c in undone)
