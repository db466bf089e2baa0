"""Predicates and look-ups by pattern, position and name."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import once, plain


def like_any(text: Column, patterns: Sequence[str]) -> Column:
    """Like one of the patterns, in any case."""
    return reduce(lambda a, b: a | b, (F.lower(text).like(p.lower()) for p in patterns), F.lit(False))


def like_none(text: Column, patterns: Sequence[str]) -> Column:
    return ~like_any(text, patterns)


def plain_like(text: Column, pattern: str) -> Column:
    """Like a pattern, without regard to case and accents."""
    return plain(text).like(pattern)


def matches(text: Column, pattern: str) -> Column:
    """A regular expression in any case, letters beyond ASCII included."""
    return text.rlike(f"(?iu){pattern}")


def lacks(items: Column, value: str) -> Column:
    """There are items, and none is the value."""
    return (F.size(items) > 0) & ~F.array_contains(items, value)


def has_bases(types: Column, ids: Column) -> Column:
    """An aggregate: some document of a group is called bases and can be fetched."""
    return F.coalesce(F.bool_or(plain(types).contains("bases") & ids.isNotNull()), F.lit(False))


def page_unless_docx(page: Column, file: Column) -> Column:
    """Word files have no pages."""
    return F.when(~F.coalesce(F.lower(file).endswith(".docx"), F.lit(False)), page)


def paired_by_place(left: Column, right: Column) -> Column:
    """Array of (first, second) by position; null unless both have as many items."""
    return F.when(F.size(left) == F.size(right), F.zip_with(left, right, lambda a, b: F.struct(a.alias("first"), b.alias("second"))))


# The factors of the standard bases, each by a word of its name, the most telling first.
FACTORS = (
    ("FORMACI", "Formación académica adicional del personal clave"),
    ("CERTIFICACIONES", "Certificaciones adicionales del personal clave"),
    ("PERSONAL", "Experiencia específica adicional del personal clave"),
    ("POSTOR", "Experiencia adicional del postor en la especialidad"),
    ("AMBIENTAL", "Sostenibilidad ambiental"),
    ("SOCIAL", "Sostenibilidad social"),
    ("INTEGRIDAD", "Integridad en la contratación pública"),
    ("CALIDAD", "Gestión de calidad"),
    ("SEGURIDAD", "Seguridad y salud"),
    ("CAPACITACI", "Capacitación"),
    ("MEJORA", "Mejora al requerimiento"),
    ("RIESGO", "Gestión de riesgos"),
    ("PROCURA", "Gestión de procura"),
    ("PLANIFICACI", "Planificación detallada"),
    ("BIM", "Plan de ejecución BIM"),
    ("TECNOLOG", "Tecnología y métodos innovadores"),
)
UNNAMED = "factor de nombre ilegible"


def named(words: Column, names: Sequence[tuple[str, str]] = FACTORS, otherwise: str | None = None) -> Column:
    """The name whose word stands in the text, the first in order."""
    found = [F.when(F.upper(words).contains(word), name) for word, name in names]
    return F.coalesce(*found, F.lit(otherwise))


def first_object(text: Column) -> Column:
    """The JSON object within other words: from the first brace to the last, null where that is no object."""
    # within brackets, since the parser stops at the end of the first value
    whole = lambda found: F.try_parse_json(F.concat(F.lit("["), found, F.lit("]"))).isNotNull()
    return once(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), lambda found: F.when(whole(found), found))


def jsonp(text: Column) -> Column:
    """What stands within the call of a JSONP answer."""
    return F.nullif(F.regexp_extract(F.trim(text), r"(?s)\A[\w.$]+\s*\((.*)\)\s*;?\s*\z", 1), F.lit(""))


def most_common_starts(df: DataFrame, key: Sequence[str], start: str) -> DataFrame:
    """(key, start): of a key's values that are at least a third as common as its most common one (and stand three times), the least. Values are counted before they meet."""
    counts = df.groupBy(*key, start).agg(F.count("*").alias("_n"))
    top = F.max("_n").over(Window.partitionBy(*key))
    enough = F.least(top.cast("double"), F.greatest(F.lit(3.0), top / 3))
    return counts.withColumn("_enough", F.col("_n") >= enough).filter("_enough").groupBy(*key).agg(F.min(start).alias(start))
