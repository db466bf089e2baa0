"""Date ranges that a capped search can show in full."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from datetime import date, timedelta
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def halved(first: date, last: date, count, cap: int) -> list[tuple[date, date, int]]:
    """Ranges of under `cap` rows, or of one day. Left parts end at first + floor(days / 2), right ones begin the day after."""
    n = count(first, last)
    if n < cap or first >= last:
        return [(first, last, n)]
    middle = first + timedelta(days=(last - first).days // 2)
    return halved(first, middle, count, cap) + halved(middle + timedelta(days=1), last, count, cap)


def leaves(days: DataFrame, day: str, n: str, cap: int) -> DataFrame:
    """(first_day, last_day, n) of the ranges that halving the whole one gives.

    days: a row a day at most, so what comes to the driver is bounded by the calendar (366 rows a year), not by the data.
    """
    rows = days.filter(F.col(day).isNotNull()).groupBy(day).agg(F.sum(n).cast("long").alias("n")).orderBy(day).collect()
    at, before = [r[0] for r in rows], [0, *accumulate(r["n"] for r in rows)]
    count = lambda a, b: before[bisect_right(at, b)] - before[bisect_left(at, a)]
    found = halved(at[0], at[-1], count, cap) if at else []
    return days.sparkSession.createDataFrame(found, "first_day date, last_day date, n long")
