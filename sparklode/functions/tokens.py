"""The token hierarchy of a cell: four levels of delimiters, split bits, parents; and the splitting of phrases.

A cell is cut at the delimiters of level 0, the pieces at those of level 1, and so on. What is cut stays a token of its
own, the parent of its pieces, except for a whole cell that level 0 cuts: sentences are not stored. Bit 0 of a token's
split bits says that it is a whole cell that nothing has cut yet; bit L + 1 that level L left it whole or made it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Delimiters by level: white space, quotes and brackets; path and address parts; dotted parts; hyphens and underscores.
LEVELS = ("\r\n\t'\"<>(),|!;{}* ", "/@=:\\?&", ".$#`~^+", "-_")


def char_class(level: int) -> str:
    """A regular expression for one delimiter of the level; Python, Java and RE2 read it alike."""
    named = {"\r": r"\r", "\n": r"\n", "\t": r"\t"}
    return "[" + "".join(named.get(c) or (c if c.isalnum() or c in " '\"<>,;!" else "\\" + c) for c in LEVELS[level]) + "]"


_CUT = [re.compile(char_class(k)) for k in range(4)]
Token = tuple[str, int, str | None]


def shred(text: str, bits: int = 1, parent: str | None = None, level: int = 0) -> Iterator[Token]:
    """(token, split bits, parent) of a cell, parents before their pieces. An empty text has none."""
    if not text:
        return
    while level < 4:
        parts = [p for p in _CUT[level].split(text) if p]
        own = 2 << level
        if len(parts) == 1 and parts[0] == text:
            bits |= own
            level += 1
            continue
        if bits != 1:
            yield text, bits, parent
            parent = text
        for p in parts:
            yield from shred(p, own, parent, level + 1)
        return
    yield text, bits, parent


class Shredder:
    """shred with a memory of words: what a piece of level 0 becomes depends on the piece alone."""

    def __init__(self, limit: int = 200_000):
        self.known: dict[str, list[Token]] = {}
        self.limit = limit

    def __call__(self, text: str) -> list[Token]:
        parts = [p for p in _CUT[0].split(text) if p]
        if not parts or (len(parts) == 1 and parts[0] == text):
            return list(shred(text))
        out: list[Token] = []
        for p in parts:
            got = self.known.get(p)
            if got is None:
                got = list(shred(p, 2, None, 1))
                if len(self.known) < self.limit:
                    self.known[p] = got
            out += got
        return out


def split_phrase(text: str) -> list[str]:
    """The tokens that a phrase search looks up, sorted and distinct. A level that leaves a single other piece, as at a
    leading or trailing delimiter, gives no token."""
    out: set[str] = set()

    def walk(t: str, level: int) -> None:
        while level < 4:
            parts = [p for p in _CUT[level].split(t) if p]
            if len(parts) > 1:
                out.add(t)
                for p in parts:
                    walk(p, level + 1)
                return
            if len(parts) == 1 and parts[0] != t:
                return
            level += 1
        out.add(t)

    if text:
        walk(text, 0)
    return sorted(out)


def atoms(text: str) -> list[str]:
    """The pieces between delimiters of any level, empty ones at the ends included."""
    return re.split("|".join(char_class(k) for k in range(4)), text)


def phrase_level(text: str) -> int:
    """The lowest level of which text holds a delimiter; 4 if it holds none."""
    return next((k for k in range(4) if _CUT[k].search(text)), 4)


def split_level(bits: Column) -> Column:
    """The lowest level in split bits: that of the lowest set bit above bit 0."""
    out = F.lit(4)
    for k in (3, 2, 1, 0):
        out = F.when(bits.bitwiseAND(2 << k) != 0, F.lit(k)).otherwise(out)
    return out
