"""Whole-word, case-insensitive search for many terms in one pass over a text's words."""

from __future__ import annotations

import re
from collections.abc import Sequence

_WORD = re.compile(r"\w+")  # letters and numbers of any script, and underscores


def is_word(c: str) -> bool:
    return c == "_" or c.isalnum()


def _fold_one(c: str) -> str:
    """One character for one, so that places stay."""
    low = c.upper().lower() if len(c.upper()) == 1 else c.lower()
    return low if len(low) == 1 else c


def folded(text: str) -> str:
    if text.isascii():
        return text.lower()
    return "".join(map(_fold_one, text))


class TermIndex:
    """Terms by their first word: a text's words are looked up, so the work follows words and hits, not terms."""

    def __init__(self, terms: Sequence[str]):
        self.terms = [folded(t) for t in terms]
        self.by_word: dict[str, list[tuple[int, int]]] = {}
        self.marks: list[int] = []
        for k, term in enumerate(self.terms):
            first = _WORD.search(term)
            if first:
                self.by_word.setdefault(first[0], []).append((first.start(), k))
            elif term:
                self.marks.append(k)

    def hits(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, number of the term) of every occurrence with word edges on both sides; those of one term do not
        overlap each other. In order of term and place."""
        low, ends, out = folded(text), dict[int, int](), []

        def take(start: int, k: int) -> None:
            end = start + len(self.terms[k])
            if start < ends.get(k, 0) or not low.startswith(self.terms[k], start):
                return
            if (start and is_word(text[start - 1])) or (end < len(text) and is_word(text[end])):
                return
            ends[k] = end
            out.append((start, end, k))

        if self.by_word:
            for m in _WORD.finditer(low):
                for lead, k in self.by_word.get(m[0], ()):
                    if m.start() >= lead:
                        take(m.start() - lead, k)
        for k in self.marks:
            at = low.find(self.terms[k])
            while at >= 0:
                take(at, k)
                at = low.find(self.terms[k], at + 1)
        return sorted(out, key=lambda h: (h[2], h[0]))
