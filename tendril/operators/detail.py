"""The page of a tender: its warnings in three groups, each with the page that it came from.

`consultar` are contradictions of the document, to be asked; `mirar` what has to be looked at on the page first, since it was
read by OCR or two readings differ; `revisar` what could not be read. How a warning is put into words, and where it
goes, is a table (`SAID`); records come as `protocol` makes them, each with where it was read from.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.amounts import MONEY, format_money
from .provenance import OCR

ASK, LOOK, MANUAL = "consultar", "mirar", "revisar"


@dataclass(frozen=True)
class Said:
    """A warning in words: pieces of text around {stated} and {expected}; money: they are amounts. by_ocr, otherwise: its group."""

    text: str
    money: bool = False
    by_ocr: str = LOOK
    otherwise: str = ASK


# The words of the page.
SAID: dict[str, dict[str, Said]] = {
    "amount": {
        "limite_inferior": Said("Límite inferior: las bases dicen {stated}; el 95 % de la cuantía, redondeado hacia arriba, es {expected}.", True),
        "limite_superior": Said("Límite superior: las bases dicen {stated}; el 110 % de la cuantía, sin redondear, es {expected}.", True),
        "fija_con_limites": Said("El capítulo IV dice que la oferta es FIJA, pero el punto 1.4 trae un cuadro de límites."),
        "limitada_sin_limites": Said("El capítulo IV dice que la oferta es LIMITADA, pero el punto 1.4 no trae el cuadro de límites."),
        "tipo_oferta_sin_rellenar": Said("El capítulo IV no dice si la oferta es fija o limitada: quedó el texto del modelo de bases."),
        "cuantia_distinta_letras": Said("La cuantía en cifras ({stated}) no es la que dicen las letras ({expected}).", True),
        "cuantia_distinta_seace": Said("La cuantía de las bases ({stated}) no es la de la ficha ({expected}).", True),
    },
    "object": {
        "nombre_distinto_seace": Said("El nombre de la obra en las bases no se parece a la descripción: puede ser otra obra o un nombre mal leído.", otherwise=LOOK),
        "cui_distinto_seace": Said("El CUI de las bases ({stated}) no es el que nombra la descripción ({expected}): puede ser otra obra."),
    },
    "personnel": {"tiempo_distinto_letras": Said("El tiempo en cifras ({stated}) no es el que dicen las letras ({expected}).")},
    "factors": {
        "suma_distinta_total": Said("Los puntajes del cuadro resumen suman {stated}, pero el puntaje total dice {expected}.", by_ocr=ASK),
        "total_distinto_100": Said("El puntaje total del cuadro resumen es {stated}, no 100.", by_ocr=ASK),
        "factor_sin_rellenar": Said("En el cuadro resumen quedó el texto del modelo en: {stated}. No dice si se evalúan.", by_ocr=ASK),
        "puntaje_distinto": Said("El cuadro resumen da {stated} puntos y la descripción del factor {expected}.", by_ocr=ASK),
    },
    "experience": {"monto_letras": Said("Experiencia del postor: el monto es {stated}, en letras {expected}.", True, MANUAL, MANUAL)},
}
UNREAD = {"amount": "Revisar a mano: ", "experience": "Experiencia del postor: ", "personnel": "Personal clave: ", "factors": "Factores de evaluación: "}
NOT_FETCHED, NOT_READ = "Bases todavía no descargadas.", "Bases descargadas, todavía sin leer."
DIFFER = "Las dos lecturas del escaneo no coinciden en {}. Mirar la página."
ORDER = ("amount", "object", "experience", "personnel", "factors")


def page_link(tender: Column, document: Column, file: Column, page: Column) -> Column:
    """A link that opens a file at a page; null without document and file, without a page to its beginning."""
    name = F.replace(F.url_encode(file), F.lit("+"), F.lit("%20"))
    at = F.when(page.isNotNull(), F.concat(F.lit("#page="), page.cast("string"))).otherwise("")
    return F.concat(F.lit("/obras/"), tender.cast("string"), F.lit("/bases/"), document.cast("string"), F.lit("/"), name, at)


def _filled(said: Said, w: Column) -> Column:
    shown = lambda v: format_money(v.try_cast(MONEY)) if said.money else v
    text = F.lit(said.text)
    for name in ("stated", "expected"):
        if f"{{{name}}}" in said.text:
            text = F.replace(text, F.lit(f"{{{name}}}"), F.coalesce(shown(w[name]), F.lit("")))
    return text


def _note(group: Column, text: Column, page: Column) -> Column:
    return F.struct(group.alias("group"), text.alias("text"), page.cast("long").alias("page"))


def _of_reader(name: str, record: Column, source: Column, second: Column | None) -> list[Column]:
    """Arrays of notes of one record."""
    table, scanned = SAID[name], source.eqNullSafe(F.lit(OCR))

    def told(w: Column) -> Column:
        group, text = F.lit(None).cast("string"), w["warning"]
        for warning, said in table.items():
            hit = w["warning"] == warning
            group = F.when(hit, F.when(scanned, said.by_ocr).otherwise(said.otherwise)).otherwise(group)
            text = F.when(hit, _filled(said, w)).otherwise(text)
        return _note(F.coalesce(group, F.when(scanned, LOOK).otherwise(ASK)), text, record["page"])

    out = [F.transform(record["warnings"], told)]
    if name in UNREAD:
        out.insert(0, F.when(record["review"].isNotNull(), F.array(_note(F.lit(MANUAL), F.concat(F.lit(UNREAD[name]), record["review"]), record["page"]))))
    if second is not None:
        out.append(F.transform(second, lambda field: _note(F.lit(LOOK), F.replace(F.lit(DIFFER), F.lit("{}"), field), record["page"])))
    return out


def notes(df: DataFrame, tender: str, document: str, file: str, records: Mapping[str, Column], source: Column, second: Mapping[str, Column] | None = None) -> DataFrame:
    """(tender, group, place, text, page, link): the notes of each tender; places are those in the order of ORDER, over all groups.

    document: the tender's bases, null where none is there; records by reader's name, all null where the bases are not
    read; a file of Word has no pages. second: the fields in which a second reading differs, by reader.
    """
    paged = ~F.coalesce(F.lower(F.col(file)).endswith(".docx"), F.lit(False))
    single = lambda text: F.array(_note(F.lit(MANUAL), F.lit(text), F.lit(None)))
    none_read = F.greatest(*(r["warnings"].isNotNull() for r in records.values()), F.lit(False)) == F.lit(False)
    known = [n for name in ORDER if name in records for n in _of_reader(name, records[name], source, (second or {}).get(name))]
    empty = F.array().cast("array<struct<group: string, text: string, page: bigint>>")
    every = F.when(F.col(document).isNull(), single(NOT_FETCHED)).when(none_read, single(NOT_READ)).otherwise(F.concat(*(F.coalesce(n, empty) for n in known)))
    listed = df.select(tender, document, file, F.posexplode(every).alias("at", "n"))
    page = F.when(paged, F.col("n.page"))
    return listed.select(tender, F.col("n.group").alias("group"), (F.col("at") + 1).alias("place"), F.col("n.text").alias("text"), page.alias("page"), F.when(F.col("n.page").isNotNull() | ~paged, page_link(F.col(tender), F.col(document), F.col(file), page)).alias("link"))
