"""Limits of an offer read from a table: amounts under the heads of the lower and the upper limit.

Layout text keeps columns by position; a table written a row a line keeps them by cell. Heads are found on one line.
"""

from __future__ import annotations

import re

# Heads of the columns, and what an amount looks like.
LOWER, UPPER = r"L[IÍ]MITE\s+INFERIOR", r"L[IÍ]MITE\s+SUPERIOR"
AMOUNT_HEAD = r"CUANT[IÍ]A\s+DE\s+LA|VALOR\s+REFERENCIAL"
WITH_TAX, WITHOUT_TAX = r"con\s+IGV", r"sin\s+IGV"
NUMBER = r"(\d[\d,.’'´ ]{0,22}?[.,] ?\d{2})(?!\d)"

#: A table's lines below its heads.
LINES = 14
FIELDS = ("low", "high", "low_without_tax", "high_without_tax")

_LOWER, _UPPER, _AMOUNT, _WITH, _WITHOUT = (re.compile(p, re.I) for p in (LOWER, UPPER, AMOUNT_HEAD, WITH_TAX, WITHOUT_TAX))
_NUMBER, _GAP = re.compile(NUMBER), re.compile(r" {3,}")


def _middles(pattern: re.Pattern, line: str) -> list[float]:
    return [sum(m.span()) / 2 for m in pattern.finditer(line)]


def by_cell(head: str, below: list[str]) -> dict[str, str]:
    """The amounts in the two cells under the heads, of the first line with as many cells as the head."""
    heads = _GAP.split(head.strip())
    place = {name: next((k for k, cell in enumerate(heads) if p.search(cell)), -1) for name, p in (("low", _LOWER), ("high", _UPPER))}
    if -1 in place.values() or place["low"] == place["high"]:
        return {}
    for line in below:
        row = _GAP.split(line.strip())
        if len(row) == len(heads):
            found = {name: m[1] for name, k in place.items() if (m := _NUMBER.search(row[k]))}
            if len(found) == 2:
                return found
    return {}


def by_column(lines: list[str], k: int) -> dict[str, str]:
    """The first amount of each column of the table whose heads are on line k; an amount is of the column whose middle is next to its own."""
    low, high = _middles(_LOWER, lines[k])[0], _middles(_UPPER, lines[k])[0]
    taxes = next((x for x in lines[k + 1 : k + 3] if len(_WITH.findall(x)) >= 2), None)
    if taxes is None:
        columns = {"low": low, "high": high}
    else:
        columns = dict(zip(FIELDS, [*_middles(_WITH, taxes)[:2], *_middles(_WITHOUT, taxes)[:2]], strict=False))
    over = next((m for x in (lines[k], lines[k - 1] if k else "") for m in _middles(_AMOUNT, x)), None)
    # without a head of its own the amount's column is what lies further left than the limits are apart by half
    columns["amount"] = over if over is not None else columns["low"] - (columns["high"] - columns["low"])
    found: dict[str, str] = {}
    for line in lines[k + 1 : k + 1 + LINES]:
        if _LOWER.search(line):  # another table
            break
        for m in _NUMBER.finditer(line):
            found.setdefault(min(columns, key=lambda c: abs(columns[c] - sum(m.span()) / 2)), m[1])
    return {name: value for name, value in found.items() if name != "amount"}


def limits(block: str | None) -> dict[str, str] | None:
    """Amounts as written, by FIELDS; none if no line has both heads, the lower one first."""
    lines = (block or "").split("\n")
    for k, line in enumerate(lines):
        low, high = _LOWER.search(line), _UPPER.search(line)
        if low and high and low.start() < high.start():
            below = lines[k + 1 : k + 1 + LINES]
            taxed = any(len(_WITH.findall(x)) >= 2 for x in below[:2])
            found = {} if taxed else by_cell(line, below)
            return {name: None for name in FIELDS} | (found or by_column(lines, k))
    return None
