"""Amounts of money: reading, limits, checks, writing. Decimals throughout, never floats."""

from __future__ import annotations

import re
from decimal import ROUND_CEILING, ROUND_FLOOR, ROUND_HALF_EVEN, Decimal
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once

MONEY = "decimal(15,2)"
MARKS = ".,'’´ "
CENT, LARGEST = Decimal("0.01"), Decimal(10) ** 13
_OTHER, _MARKED = re.compile(f"[^0-9{MARKS}]+"), re.compile(f"[{MARKS}]+")


def money(text: Column) -> Column:
    """An amount as entities write it: the last mark before exactly two closing digits is the decimal point, other marks group.

    Marks: comma, point, space and three apostrophes. Null where nothing is left.
    """
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, r"[^0-9.,'’´ ]", ""), r"^[^0-9]+|[^0-9]+$", ""))

    def value(b: Column) -> Column:
        cents = F.regexp_extract(b, r"[.,'’´ ]([0-9]{2})$", 1)
        return once(cents, lambda c: _number(F.regexp_replace(F.when(c != "", F.substring(b, F.lit(1), F.length(b) - 3)).otherwise(b), "[^0-9]", ""), c))

    return once(bare, value)


@lru_cache(10_000)
def read_money(written: str | None) -> Decimal | None:
    """`money` of one text. A reader asks for each figure of a text several times."""
    bare = _OTHER.sub("", written or "").strip(MARKS)
    if not bare:
        return None
    parted = len(bare) > 2 and bare[-3] in MARKS and bare[-2:].isdigit()
    digits = _MARKED.sub("", bare[:-3] if parted else bare)
    value = Decimal(f"{digits or 0}.{bare[-2:] if parted else '00'}")
    return value if value < LARGEST else None


def _number(whole: Column, cents: Column) -> Column:
    return F.when((whole != "") | (cents != ""), F.concat(F.when(whole == "", "0").otherwise(whole), F.lit("."), F.when(cents == "", "00").otherwise(cents)).try_cast(MONEY))


def typed_amount(text: Column) -> Column:
    """An amount typed by a user: currency sign, commas and spaces dropped; null if unreadable or negative."""
    value = F.regexp_replace(F.upper(text), r"S/\.?|[,\s]", "").try_cast(MONEY)
    return F.when(value >= 0, value)


def portal_amount(text: Column) -> Column:
    """An amount as the portal writes it: dashes are null, anything else must be a number."""
    bare = F.replace(F.trim(text), F.lit(","), F.lit(""))
    return F.when(bare.rlike("^-*$"), F.lit(None)).otherwise(bare).cast(MONEY)


def lower_limit(amount: Column) -> Column:
    """95 %, up to the next cent."""
    return F.ceil(amount * F.lit("0.95").cast("decimal(3,2)"), F.lit(2)).cast(MONEY)


def upper_limit(amount: Column) -> Column:
    """110 %, down to the cent."""
    return F.floor(amount * F.lit("1.10").cast("decimal(3,2)"), F.lit(2)).cast(MONEY)


def limits_of(amount: Decimal) -> tuple[Decimal, Decimal]:
    """Lower and upper limit of one amount."""
    return (amount * 95 / 100).quantize(CENT, ROUND_CEILING), (amount * 110 / 100).quantize(CENT, ROUND_FLOOR)


def rounded(value: Decimal, places: str = "0.01") -> Decimal:
    """Half to even."""
    return value.quantize(Decimal(places), ROUND_HALF_EVEN)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole at three places, half to even."""
    return F.bround(part.cast("decimal(38,10)") / whole.cast("decimal(20,2)"), 3)


def plausible_times(times: Column) -> Column:
    return times.between(0.25, 3.0)


def plausible_limit(limit: Column, amount: Column) -> Column:
    return (limit / amount).between(0.70, 1.30)


def plausible_without_tax(without: Column, with_tax: Column) -> Column:
    return (without / with_tax).between(0.84, 0.855)


def nearest(candidates: Column, target: Column, spread: Column) -> Column:
    """Of an array, the value next to the target and within the spread of it; null if there is none."""
    near = F.filter(candidates, lambda x: F.abs(x - target) <= spread)
    return F.array_min(F.transform(near, lambda x: F.struct(F.abs(x - target).alias("off"), x.alias("value"))))["value"]


def format_money(amount: Column) -> Column:
    """`S/ 1,234.50`."""
    return F.concat(F.lit("S/ "), F.format_number(amount, 2))


def format_short(amount: Column) -> Column:
    """`S/ 1.234`: grouped by points, without cents."""
    return F.concat(F.lit("S/ "), F.replace(F.format_number(amount, 0), F.lit(","), F.lit(".")))


def csv_amount(amount: Column) -> Column:
    """Decimal comma, two places, null as empty."""
    return F.coalesce(F.replace(amount.cast(MONEY).cast("string"), F.lit("."), F.lit(",")), F.lit(""))


def coalesce_amount(read: Column, stated: Column) -> Column:
    """The amount that was read, else the one stated; an empty reading counts as none."""
    return F.coalesce(F.nullif(read, F.lit("")).try_cast(MONEY), stated.cast(MONEY))


def experience_amount(flagged: Column, amount: Column, times: Column, of: Column) -> Column:
    """The experience asked for: null if flagged; else the amount; else so many times the tender's."""
    by_times = (times.cast("decimal(10,4)") * of.cast(MONEY)).cast(MONEY)
    return F.when(F.coalesce(flagged, F.lit(False)), F.lit(None)).otherwise(F.coalesce(amount.cast(MONEY), by_times))
