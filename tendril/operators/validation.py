"""Typed validation of hand-filled rows: schemas compiled to rules over JSON, with the path of each faulty cell.

A row is a JSON object. It must have just the columns of its schema, and each value must be of its column's kind; the first
thing that is wrong, in the order of the schema, is the row's fault. Kinds are texts, whole numbers, numbers, truths, lists
of texts, one of some values, and scales: lists of steps, each of which is a row by a schema of its own. A schema may depend
on a column (`Tagged`): its value says which further columns there are.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import once

TEXT, OPTIONAL_TEXT, WHOLE, NUMBER, TRUTH, LIST, OPTIONAL_LIST = "text", "optional text", "whole", "number", "truth", "list", "optional list"

EXPECTED = {
    TEXT: "text",
    OPTIONAL_TEXT: 'text, or "" where it does not apply',
    WHOLE: "a whole number above 0",
    NUMBER: "a number above 0",
    TRUTH: "true or false",
    LIST: "a list of texts, not empty",
    OPTIONAL_LIST: "a list of texts",
}


@dataclass(frozen=True)
class Scale:
    """A list of steps, not empty."""

    steps: tuple[tuple[str, Kind], ...]


@dataclass(frozen=True)
class Tagged:
    """Columns for all rows, one of which (`tag`) must be one of `more`, and the further columns for each of its values."""

    columns: tuple[tuple[str, Kind], ...]
    tag: str
    more: Mapping[str, tuple[tuple[str, Kind], ...]]


#: A kind: one of the words above, a tuple of allowed texts, or a scale.
Kind = str | tuple[str, ...] | Scale
Columns = Sequence[tuple[str, Kind]]


_RULE = "name string, kind string, allowed array<string>"


def _rule(name: str, kind: Kind) -> dict:
    steps = [_rule(*step) for step in kind.steps] if isinstance(kind, Scale) else []
    return {"name": name, "kind": "scale" if steps else "choice" if isinstance(kind, tuple) else kind, "allowed": list(kind) if isinstance(kind, tuple) else [], "steps": steps}


def compiled(schemas: Mapping[str, Columns | Tagged]) -> tuple[Column, Column]:
    """Constants of the plan: the rules of each field (of a tagged one, of `field:value`), and the tag of each tagged field.

    Rules are data, so the expression that checks them does not grow with the schemas.
    """
    rules: dict[str, list[dict]] = {}
    tags: dict[str, dict] = {}
    for field, schema in schemas.items():
        if isinstance(schema, Tagged):
            own = (schema.tag, tuple(schema.more))
            tags[field] = _rule(*own)
            rules |= {f"{field}:{value}": [_rule(*c) for c in (*schema.columns, own, *more)] for value, more in schema.more.items()}
        else:
            rules[field] = [_rule(*c) for c in schema]
    constant = lambda value, kind: F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), kind)
    return constant(rules, f"map<string, array<struct<{_RULE}, steps array<struct<{_RULE}>>>>>"), constant(tags, f"map<string, struct<{_RULE}>>")


def _values(row: Column) -> Column:
    """The values of a row (a variant) by column, null where it is no object. A path made of a column would be parsed anew for each value."""
    return F.try_variant_get(row, "$", "map<string, variant>")


def _value_fault(rule: Column, values: Column, path: Column, steps: Callable[[Column], Column] | None = None) -> Column:
    """Why a row's value is not of its rule's kind, null if it is; values: variants by column; steps: the fault of an array of steps."""
    kind = rule["kind"]
    # only what the kind asks for is read: reading a text as a number costs an exception
    read = lambda v, type_, *kinds: F.when(kind.isin(*kinds), F.try_variant_get(v, "$", type_))
    seen = once(
        F.try_element_at(values, rule["name"]),
        lambda v: F.struct(
            v.alias("value"), F.schema_of_variant(v).alias("type"), read(v, "string", TEXT, "choice").alias("text"), read(v, "double", WHOLE, NUMBER).alias("number"), read(v, "array<string>", LIST, OPTIONAL_LIST).alias("texts"), read(v, "array<variant>", "scale").alias("rows"),
        ),
    )

    def fault(x: Column) -> Column:
        type_ = x["type"]
        full = F.forall(x["texts"], lambda t: F.coalesce(F.trim(t) != "", F.lit(False)))
        listed = (type_ == "ARRAY<STRING>") & full
        ok = (
            F.when(kind == TEXT, (type_ == "STRING") & (F.trim(x["text"]) != ""))
            .when(kind == OPTIONAL_TEXT, type_ == "STRING")
            .when(kind == WHOLE, (type_ == "BIGINT") & (x["number"] > 0))
            .when(kind == NUMBER, type_.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (x["number"] > 0))
            .when(kind == TRUTH, type_ == "BOOLEAN")
            .when(kind == LIST, listed & (F.size(x["texts"]) > 0))
            .when(kind == OPTIONAL_LIST, listed | (type_ == "ARRAY<VOID>") & (F.size(x["texts"]) == 0))
            .when(kind == "choice", (type_ == "STRING") & F.array_contains(rule["allowed"], x["text"]))
            .when(kind == "scale", (F.size(x["rows"]) > 0) & F.forall(x["rows"], lambda s: F.schema_of_variant(s).startswith("OBJECT")))
        )
        expected = F.when(kind == "choice", F.concat(F.lit("one of "), F.array_join(rule["allowed"], " | "))).when(kind == "scale", "a list of steps").otherwise(F.element_at(_expected(), kind))
        said = F.concat(path, F.lit(": `"), rule["name"], F.lit("` must be "), expected, F.lit(", got "), F.coalesce(F.to_json(x["value"]), F.lit("nothing")))
        inner = F.when(kind == "scale", steps(x["rows"])) if steps else F.lit(None).cast("string")
        return F.when(~F.coalesce(ok, F.lit(False)), said).otherwise(inner)

    return once(seen, fault)


def _expected() -> Column:
    return F.from_json(F.lit(json.dumps(EXPECTED, ensure_ascii=False)), "map<string, string>")


def _row_fault(rules: Column, values: Column, path: Column, steps: Callable[[Column], Callable[[Column], Column]] | None = None) -> Column:
    """The first fault of a row, whose values are given by column: its set of columns, then each value in the order of the rules."""
    wanted = F.transform(rules, lambda r: r["name"])
    listed = lambda names: F.concat(F.lit("["), F.array_join(F.array_sort(names), ", "), F.lit("]"))

    def names(h: Column) -> Column:
        unknown, missing = F.array_except(h, wanted), F.array_except(wanted, h)
        return F.when(F.size(unknown) + F.size(missing) > 0, F.concat(path, F.lit(": unknown columns "), listed(unknown), F.lit(", missing columns "), listed(missing)))

    first = F.get(F.filter(F.transform(rules, lambda r: _value_fault(r, values, path, steps(r) if steps else None)), lambda f: f.isNotNull()), F.lit(0))
    return F.coalesce(once(F.coalesce(F.map_keys(values), F.array().cast("array<string>")), names), first)


def faults(df: DataFrame, record: Sequence[str], field: str, number: str, row: str, schemas: Mapping[str, Columns | Tagged]) -> DataFrame:
    """(record, field, number, fault) of the rows that are not as the schema of their field says.

    df: a row for each filled row, with its field, its number within the field (null for a block) and its JSON (`row`). What
    is no JSON object, and a field without a schema, are faults too.
    """
    all_rules, tags = compiled(schemas)
    staged = df.withColumn("_row", F.try_parse_json(F.col(row))).withColumn("_path", F.concat_ws(" ", F.col(field), F.col(number).cast("string"))).withColumn("_tag", F.try_element_at(tags, F.col(field)))
    staged = staged.withColumn("_value", F.try_variant_get(F.col("_row"), F.concat(F.lit("$."), F.col("_tag.name")), "string"))
    staged = staged.withColumn("_rules", F.try_element_at(all_rules, F.when(F.col("_tag").isNull(), F.col(field)).otherwise(F.concat_ws(":", F.col(field), F.col("_value")))))
    is_object = F.coalesce(F.schema_of_variant(F.col("_row")).startswith("OBJECT"), F.lit(False))

    def step_faults(rule: Column) -> Callable[[Column], Column]:
        place = lambda i: F.concat(F.col("_path"), F.lit(": "), rule["name"], F.lit(" "), (i + 1).cast("string"))
        return lambda rows: F.get(F.filter(F.transform(rows, lambda s, i: once(_values(s), lambda values: _row_fault(rule["steps"], values, place(i)))), lambda f: f.isNotNull()), F.lit(0))

    def fault(values: Column) -> Column:
        return (
            F.when(~F.col(field).isin(*schemas), F.concat("_path", F.lit(": unknown field")))
            .when(~is_object, F.concat("_path", F.lit(": no table")))
            .when(F.col("_rules").isNull(), _value_fault(F.col("_tag"), values, F.col("_path")))
            .otherwise(_row_fault(F.col("_rules"), values, F.col("_path"), step_faults))
        )

    # exploded, since a filter on the fault would be pushed below it and compute it twice
    found = F.array_compact(F.transform(F.array(_values(F.col("_row"))), fault))
    return staged.select(*record, field, number, F.explode(found).alias("fault"))


# The columns of the filled records.
COUNTED_FROM = ("acta de recepción", "conformidad o comprobante de pago")
AMOUNT_BLOCK = (("monto", NUMBER), ("cita", TEXT), ("pagina", TEXT))
EXPERIENCE_BLOCK = (
    ("monto", NUMBER), ("veces_cuantia", NUMBER), ("especialidad", TEXT), ("subespecialidades", LIST), ("tipologias", OPTIONAL_LIST), ("ventana_anios", WHOLE), ("cuenta_desde", COUNTED_FROM), ("cita", TEXT), ("pagina", TEXT),
)
POST_ROW = (
    ("cargo", TEXT), ("cantidad", WHOLE), ("profesiones", LIST), ("grado", ("título profesional", "bachiller")), ("colegiado", TRUTH), ("meses", WHOLE), ("desde_colegiatura", TRUTH), ("roles", LIST), ("areas", OPTIONAL_LIST),
    ("ambito", ("subespecialidad", "obras en general")), ("ventana_anios", WHOLE), ("cita", TEXT), ("pagina", TEXT),
)
_LEVELS = Scale((("nivel", TEXT), ("puntos", WHOLE)))
FACTOR_ROW = Tagged(
    (("letra", TEXT), ("nombre", TEXT), ("parte", TEXT), ("puntos_max", WHOLE), ("cita", TEXT), ("pagina", TEXT)),
    "tipo",
    {
        "personal_adicional": (("cargos", LIST), ("anios_extra", WHOLE), ("escala", Scale((("pct_minimo", NUMBER), ("puntos", WHOLE))))),
        "experiencia_adicional": (("ventana_anios", WHOLE), ("cuenta_desde", COUNTED_FROM), ("escala", Scale((("monto_minimo", NUMBER), ("estricto", TRUTH), ("puntos", WHOLE))))),
        "certificacion_empresa": (("certificado", TEXT), ("alcance_pedido", TEXT), ("escala", _LEVELS)),
        "capacitacion_personal": (("cargo", TEXT), ("tema", TEXT), ("escala", _LEVELS)),
        "herramienta": (("herramienta", TEXT), ("escala", _LEVELS)),
        "juicio_comite": (("que_se_juzga", TEXT), ("escala", _LEVELS)),
    },
)
SCHEMAS: dict[str, Columns | Tagged] = {"cuantia": AMOUNT_BLOCK, "experiencia_requerida": EXPERIENCE_BLOCK, "personal_clave": POST_ROW, "factores": FACTOR_ROW}
