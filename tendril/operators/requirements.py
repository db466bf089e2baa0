"""Chapters of a tender's requirements: where they stand, and how readings of them are checked against the tables.

The readings themselves come from elsewhere (a hosted model, say) and are rows of a table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import page_of
from .personnel import BARE_TITLE, TITLE

# Heads of the chapters and of what is asked for in them.
CHAPTER_III, CHAPTER_IV, CHAPTER_V = r"CAP[IÍ]TULO\s+III\b", r"CAP[IÍ]TULO\s+IV\b", r"CAP[IÍ]TULO\s+V\b"
FACTORS_HEAD, ECONOMIC = r"FACTORES\s+DE\s+EVALUACI", r"EVALUACI[OÓ]N\s+ECON[OÓ]MICA\s*\("
CAPACITY = r"CAPACIDAD\s+T[EÉ]CNICA"
NOT_FOUND = "sin capítulos III ni IV legibles"

#: Longest chapter where its end is not found.
MOST = 45_000
#: The head of the factors follows the chapter's within so many characters, and its end no sooner than so many.
HEAD_SPAN, LEAST = 4_000, 2_000
#: What comes before the posts in their chapter is at most so long.
LEAD = 12_000

_III, _IV = re.compile(CHAPTER_III), re.compile(CHAPTER_IV)
_FACTORS, _CAPACITY = re.compile(FACTORS_HEAD, re.I), re.compile(CAPACITY, re.I)
_IV_END = re.compile(f"{ECONOMIC}|{CHAPTER_V}")
_POSTS = [re.compile(TITLE, re.I | re.S | re.M), re.compile(BARE_TITLE, re.I)]


def _end(pattern: re.Pattern, text: str, at: int) -> int | None:
    m = pattern.search(text, at)
    return m.start() if m else None


def factor_chapter(text: str) -> tuple[int, int] | None:
    """From the chapter whose head is soon followed by that of the factors, to the economic evaluation or the next chapter."""
    for head in _IV.finditer(text):
        if _FACTORS.search(text, head.start(), head.start() + HEAD_SPAN):
            end = _end(_IV_END, text, head.start() + LEAST)
            return head.start(), head.start() + MOST if end is None else end
    return None


def personnel_chapter(text: str) -> tuple[int, int] | None:
    """From the technical capacity that opens the posts, or shortly before them, to the next chapter; a chapter without posts is another one's."""
    for head in _III.finditer(text):
        end = _end(_IV, text, head.end())
        stop = head.end() + MOST if end is None else end
        posts = next((m.start() for search in _POSTS if (m := search.search(text, head.end(), stop))), None)
        if posts is not None:
            near = max(head.start(), posts - LEAD)
            return max((m.start() for m in _CAPACITY.finditer(text, near, posts)), default=near), stop
    return None


_SCHEMA = T.StructType([T.StructField(n, T.IntegerType()) for n in ("factors_at", "factors_end", "personnel_at", "personnel_end")])


@F.pandas_udf(_SCHEMA)
def _chapters(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    nothing = (None, None)
    for texts in batches:
        rows = [(*(factor_chapter(t or "") or nothing), *(personnel_chapter(t or "") or nothing)) for t in texts]
        yield pd.DataFrame(rows, columns=_SCHEMA.names).astype("Int32")


def find_chapters(df: DataFrame, document: str = "text", name: str = "chapters") -> DataFrame:
    """df with a struct: the two chapters' places and pages, and NOT_FOUND as review where there is neither. A null text has none."""
    found = df.withColumn("_found", _chapters(F.col(document)))
    f = F.col("_found")
    page = lambda at: F.when(f[at].isNotNull(), page_of(F.col(document), f[at]))
    whole = F.struct(
        *(f[n].alias(n) for n in _SCHEMA.names),
        page("factors_at").alias("factors_page"),
        page("personnel_at").alias("personnel_page"),
        F.when(f["factors_at"].isNull() & f["personnel_at"].isNull(), NOT_FOUND).alias("review"),
    )
    return found.withColumn(name, whole).drop("_found")


def checked_factors(answers: DataFrame, summary: DataFrame, key: list[str], name: str, points: str) -> DataFrame:
    """Answers with `checked`: whether the summary table gives the factor of this name so many points (the most, where a name repeats)."""
    stated = summary.filter(F.col(points).isNotNull()).groupBy(*key, name).agg(F.max(points).alias("_points"))
    return answers.join(stated, [*key, name], "left").withColumn("checked", F.coalesce(F.col("_points") == F.col(points), F.lit(False))).drop("_points")


def checked_months(answers: DataFrame, staff: DataFrame, key: list[str], order: str, months: str) -> DataFrame:
    """(key, checked): whether the months asked for are, in order, those of the table; not if the table has none."""
    in_order = lambda what: F.transform(F.array_sort(F.collect_list(F.struct(order, months))), lambda x: x[months]).alias(what)
    asked = answers.groupBy(*key).agg(in_order("_asked"))
    read = staff.filter(F.col(months).isNotNull()).groupBy(*key).agg(in_order("_read"))
    return asked.join(read, key, "left").select(*key, F.coalesce(F.col("_asked") == F.col("_read"), F.lit(False)).alias("checked"))
