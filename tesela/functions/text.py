"""Text helpers shared by the operators."""

from __future__ import annotations

import re
import unicodedata

_WORD = re.compile(r"[^\W_]+")


class _Marks(dict[int, int | None]):
    """Deletes combining marks in ``str.translate``; each character is looked up once."""

    def __missing__(self, c: int) -> int | None:
        self[c] = None if unicodedata.combining(chr(c)) else c
        return self[c]


_MARKS = _Marks()


def plain(text: str) -> str:
    """``text`` without case and accents; letters that have no accent stay as they are."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFD", text.casefold()).translate(_MARKS)


def words(text: str) -> list[str]:
    """Maximal runs of letters or digits of ``plain(text)``."""
    return _WORD.findall(plain(text))
