"""Sentences from hand-filled records: nested rows put into words by higher-order functions, and the readings not told yet.

Each function takes a struct column by the names of its fields and gives text. A null array counts as empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.amounts import format_money
from ..functions.text import once

# The words of the report.
RECEPTION, BY_RECEPTION, BY_CONFORMITY = "acta de recepción", "el acta de recepción", "la conformidad o el pago"
SUBSPECIALTY, IN_SUBSPECIALTY, IN_GENERAL = "subespecialidad", "en la especialidad y subespecialidad", "en obras en general"
NO_SCOPE = "ninguno"
NAMES = {"cuantia": "Cuantía", "experiencia_requerida": "Experiencia pedida", "personal_clave": "Personal clave", "factores": "Factores de evaluación", "incongruencias": "Incongruencias"}


def either(names: Column) -> Column:
    return F.array_join(F.coalesce(names, F.array().cast("array<string>")), " o ")


def counted(n: Column, one: str, many: str) -> Column:
    return F.concat(shown(n), F.lit(" "), F.when(n == 1, one).otherwise(many))


def shown(n: Column) -> Column:
    """A number without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(n.cast("decimal(18,4)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def since(counted_from: Column) -> Column:
    return F.when(counted_from == RECEPTION, BY_RECEPTION).otherwise(BY_CONFORMITY)


def times_of_amount(block: Column) -> Column:
    """`S/ 1,200.00 (1.5 veces la cuantía)`."""
    return F.concat(format_money(block["monto"]), F.lit(" ("), counted(block["veces_cuantia"], "vez", "veces"), F.lit(" la cuantía)"))


def experience(block: Column) -> Column:
    kinds = F.when(F.size(block["tipologias"]) > 0, F.concat(F.lit(" (tipología "), either(block["tipologias"]), F.lit(")"))).otherwise("")
    return F.concat(times_of_amount(block), F.lit(" en "), block["especialidad"], F.lit(": "), either(block["subespecialidades"]), kinds, F.lit("; últimos "), shown(block["ventana_anios"]), F.lit(" años desde "), since(block["cuenta_desde"]))


def post(row: Column) -> Column:
    member = F.when(row["colegiado"], " colegiado").otherwise("")
    from_ = F.when(row["desde_colegiatura"], " desde la colegiatura").otherwise("")
    areas = F.when(F.size(row["areas"]) > 0, F.concat(F.lit(" en "), either(row["areas"]))).otherwise("")
    scope = F.when(row["ambito"] == SUBSPECIALTY, IN_SUBSPECIALTY).otherwise(IN_GENERAL)
    return F.concat(row["cargo"], F.lit(" ("), shown(row["cantidad"]), F.lit("): "), either(row["profesiones"]), F.lit(", "), row["grado"], member, F.lit("; "), shown(row["meses"]), F.lit(" meses"), from_, F.lit(" como "), either(row["roles"]), areas, F.lit("; "), scope, F.lit("; últimos "), shown(row["ventana_anios"]), F.lit(" años"))


def factor(row: Column) -> Column:
    """A part of a factor by its type; scales are (pct_minimo, monto_minimo, estricto, nivel, puntos), of which the type uses some."""
    steps = lambda said: F.array_join(F.transform(row["escala"], lambda s: F.concat(said(s), F.lit(" → "), shown(s["puntos"]))), "; ")
    part = F.when(row["parte"] != row["letra"], F.concat(F.lit(", "), row["parte"])).otherwise("")
    head = F.concat(row["letra"], F.lit(". "), row["nombre"], part, F.lit(" (máx. "), shown(row["puntos_max"]), F.lit("): "))
    people = F.concat(either(row["cargos"]), F.lit(" con "), counted(row["anios_extra"], "año", "años"), F.lit(" más de lo pedido; "), steps(lambda s: F.concat(shown(s["pct_minimo"]), F.lit(" % o más del personal evaluado"))))
    amounts = F.concat(steps(lambda s: F.concat(F.when(s["estricto"], "más de ").otherwise("desde "), format_money(s["monto_minimo"]))), F.lit(" (últimos "), shown(row["ventana_anios"]), F.lit(" años desde "), since(row["cuenta_desde"]), F.lit(")"))
    scope = F.when(row["alcance_pedido"] != NO_SCOPE, F.concat(F.lit(", alcance pedido: "), row["alcance_pedido"])).otherwise("")
    what = (
        F.when(row["tipo"] == "certificacion_empresa", F.concat(F.coalesce(row["certificado"], F.lit("")), scope))
        .when(row["tipo"] == "capacitacion_personal", F.concat(row["tema"], F.lit(" del "), row["cargo"]))
        .when(row["tipo"] == "herramienta", row["herramienta"])
        .when(row["tipo"] == "juicio_comite", F.concat(F.lit("lo juzga el comité: "), row["que_se_juzga"]))
    )
    levels = F.concat(F.coalesce(what, F.lit("")), F.lit("; "), steps(lambda s: s["nivel"]))
    return F.concat(head, F.when(row["tipo"] == "personal_adicional", people).when(row["tipo"] == "experiencia_adicional", amounts).otherwise(levels))


def incongruence(row: Column) -> Column:
    """What does not agree, the reading that is used, and where there is one the other reading's place and value."""
    names = F.create_map(*(F.lit(x) for pair in NAMES.items() for x in pair))
    place = once(names, lambda n: F.concat_ws(" ", F.coalesce(F.try_element_at(n, row["campo"]), row["campo"]), F.nullif(row["fila"], F.lit(""))))
    other = F.concat(F.lit(". Otra lectura: "), place, F.lit(", "), F.replace(row["columna"], F.lit("_"), F.lit(" ")), F.lit(" = "), row["valor"])
    return F.concat(F.when(row["consulta"], "Consulta: ").otherwise(""), row["descripcion"], F.lit(". Lectura usada: "), row["lectura_usada"], F.when(row["campo"] != "", other).otherwise(""))


def questions(incongruences: Column, notes: Column | None = None) -> Column:
    """How many to ask the entity; of records without rows of their own, the lines of the notes that begin so."""
    asked = F.size(F.filter(incongruences, lambda r: r["consulta"]))
    if notes is None:
        return F.coalesce(asked, F.lit(0))
    noted = F.size(F.filter(F.split(notes, "\n"), lambda line: F.lower(F.trim(line)).startswith("consulta:")))
    return F.when(incongruences.isNotNull(), asked).otherwise(noted)


def untold(readings: DataFrame, documents: DataFrame, tenders: DataFrame, document: str, tender: str, version: str = "manual") -> DataFrame:
    """Readings of a version that are done and not reported, with the columns of their document's tender."""
    own = readings.filter((F.col("state") == "done") & F.col("reported").isNull() & (F.col("version") == version))
    return own.join(documents.select(document, tender), document).join(tenders, tender)


def lines(df: DataFrame, key: Sequence[str], fields: Sequence[tuple[str, Column]]) -> DataFrame:
    """(key, place, field, text): each field's sentences in the order of fields, rows of a field in theirs. A field is an array of texts."""
    each = F.flatten(F.array(*(F.transform(F.coalesce(c, F.array().cast("array<string>")), _named(name)) for name, c in fields)))
    return df.select(*key, F.posexplode(each).alias("place", "line")).select(*key, (F.col("place") + 1).alias("place"), "line.*")


def _named(name: str):
    return lambda text: F.struct(F.lit(NAMES.get(name, name)).alias("field"), text.alias("text"))
