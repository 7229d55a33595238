"""Words of texts however dressed."""

from __future__ import annotations

import unicodedata


class _Letters(dict):
    """Letters and digits to themselves, format characters to nothing, all else to blanks; filled as characters come up."""

    def __missing__(self, c: int) -> int | None:
        char = chr(c)
        self[c] = c if char.isalnum() else None if unicodedata.category(char) == "Cf" else 32
        return self[c]


_LETTERS = _Letters()


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, in lower case, after compatibility composition and without format characters."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return text.lower().translate(_LETTERS).split()
