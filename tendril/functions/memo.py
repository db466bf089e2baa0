"""What makes readers of long texts quick: places of words found without patterns, results kept for wording that comes again."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

#: Results that are kept for each function, and the longest text they are kept for: about 20 MB in a Python worker.
KEPT, LONGEST_TEXT = 2000, 4000


def remembered(function: Callable) -> Callable:
    """A function of a text and values that can be hashed, its results kept. They must not be changed by who gets them."""
    kept = lru_cache(KEPT)(function)

    @wraps(function)
    def found(text: str, *values):
        return kept(text, *values) if len(text) <= LONGEST_TEXT else function(text, *values)

    return found


@lru_cache(1)
def _lowered(text: str) -> str:
    """All readers of a text ask for it, one after the other."""
    return text.lower()


def matches(pattern: re.Pattern, word: str, text: str, begin: int = 0, end: int | None = None, ahead: int = 0) -> Iterator[re.Match]:
    """pattern.finditer, without regard to case, of a pattern that has a word at its beginning or so many characters ahead.

    The word is in small letters, none of i, k and s, which have further letters alike. Places are those of the text, unless
    one of its letters is two in small (the dotted capital I is); then the pattern is looked for everywhere.
    """
    end = len(text) if end is None else min(end, len(text))
    low = _lowered(text)
    if len(low) != len(text):
        yield from pattern.finditer(text, begin, end)
        return
    at = low.find(word, begin + ahead, end)
    while at >= 0:
        m = pattern.match(text, at - ahead, end)
        if m:
            yield m
        at = low.find(word, m.end() + ahead if m else at + 1, end)
