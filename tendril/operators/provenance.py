"""What a reading is worth by where it was read: rules for copies made by OCR.

OCR breaks words, loses rows and misreads digits, so a contradiction in what it read is its own far more often than the
document's: such warnings are revoked, and where they show that the reading itself failed, a person must look. A model's
transcription keeps words whole; its misreadings show against the OCR reading of the same page (`protocol.compared`). All
rules are column expressions over records; a record that is null, or already under review, stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import once, plain
from .factor_table import UNREADABLE as FACTORS_UNREADABLE
from .personnel import UNREADABLE as POSTS_UNREADABLE
from .personnel import VOCABULARY

OCR = "ocr"
#: Warnings that a lost row and a misread digit make.
LOST_ROW, MISREAD = "suma_distinta_total", "puntaje_distinto"


def _doubted(record: Column, source: Column) -> Column:
    return source.eqNullSafe(F.lit(OCR)) & record.isNotNull() & record["review"].isNull()


def trusted_factors(record: Column, source: Column) -> Column:
    """A factor reading by its source: from OCR a sum beside the total means a lost row (a person must look), and a description beside a table that adds up a misread digit (no warning)."""
    names = F.transform(record["warnings"], lambda w: w["warning"])
    lost = F.coalesce(F.array_contains(names, LOST_ROW), F.lit(False))
    kept = F.filter(record["warnings"], lambda w: ~w["warning"].isin(LOST_ROW, MISREAD))
    revised = record.withField("warnings", kept).withField("review", F.when(lost, FACTORS_UNREADABLE))
    return F.when(_doubted(record, source), revised).otherwise(record)


def unknown_words(name: Column) -> Column:
    """Words of a post that no post has, as the vocabulary knows them: a bounded list, a constant of the plan."""
    words = F.filter(F.split(plain(name), r"[\s,()/–—-]+"), lambda w: w != "")
    known = F.array(*map(F.lit, sorted(VOCABULARY)))
    return once(known, lambda v: F.filter(words, lambda w: ~F.array_contains(v, w) & ~F.array_contains(v, F.rtrim(w, F.lit(".")))))


def trusted_personnel(record: Column, source: Column) -> Column:
    """A personnel reading by its source: from OCR a post with a word that no post has, or a time whose words say another number, leaves the times alone; a person must look."""
    strange = F.exists(record["staff"], lambda p: F.size(unknown_words(p["post"])) > 0) | (F.size(record["warnings"]) > 0)
    bare = record.withField("staff", F.transform(record["staff"], lambda p: p.withField("post", F.lit(None).cast("string")))).withField("warnings", F.slice(record["warnings"], 1, 0)).withField("review", F.lit(POSTS_UNREADABLE))
    return F.when(_doubted(record, source) & F.coalesce(strange, F.lit(False)), bare).otherwise(record)
