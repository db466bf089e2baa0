"""Regions named in a text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize_simple

# The 25 regions, and what stands before names of streets.
REGIONS = (
    "AMAZONAS ANCASH APURIMAC AREQUIPA AYACUCHO CAJAMARCA CALLAO CUSCO HUANCAVELICA HUANUCO ICA JUNIN LA_LIBERTAD LAMBAYEQUE LIMA LORETO MADRE_DE_DIOS MOQUEGUA PASCO PIURA PUNO SAN_MARTIN TACNA TUMBES UCAYALI".replace("_", "\0").split()
)
REGIONS = tuple(r.replace("\0", " ") for r in REGIONS)
STREETS = ("av", "avenida", "jr", "jiron", "calle", "ca", "psje", "pasaje", "prolongacion", "urb", "urbanizacion", "aahh", "asociacion")

_NAMES = "|".join(sorted((r.lower() for r in REGIONS), key=len, reverse=True))
_MARKED = rf"\b(?:departamento|region)(?: del?)? ({_NAMES})\b"
_BARE = rf"\b(?<!\b(?:{'|'.join(STREETS)})[. ]{{1,3}})({_NAMES})\b"


def _found(text: Column, pattern: str) -> Column:
    hits = F.regexp_extract_all(normalize_simple(text), F.lit(pattern), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(hits, F.upper)))


def marked(text: Column) -> Column:
    """Regions named after "departamento" or "region"."""
    return _found(text, _MARKED)


def located(text: Column) -> Column:
    """(regions, source): marked names; without one, bare names that are no street's; source text or unknown."""
    named, bare = marked(text), _found(text, _BARE)
    regions = F.when(F.size(named) > 0, named).otherwise(bare)
    return F.struct(regions.alias("regions"), F.when(F.size(regions) > 0, "text").otherwise("unknown").alias("source"))


LOCAL = r"(?iu)^\s*(municipalidad|gobierno regional)\b"


def placed(text: Column, entity: Column, searched: Column) -> Column:
    """As `located`, but a local entity found by a region's search lies in that region, unless the text marks another."""
    from_text = located(text)
    region = F.upper(normalize_simple(searched))
    there = entity.rlike(LOCAL) & region.isin(*REGIONS) & (F.size(marked(text)) == 0) & ~(from_text["regions"] == F.array(region))
    return F.when(F.coalesce(there, F.lit(False)), F.struct(F.array(region).alias("regions"), F.lit("entity").alias("source"))).otherwise(from_text)


def regions_in(text: str) -> list[str]:
    """`marked` for one normalized Python string."""
    return sorted({m[1].upper() for m in re.finditer(_MARKED, text)})
