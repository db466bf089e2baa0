"""Facets, validation of filled rows, running lines of pages, quotations, sentences."""

import json
import math
import random
import re
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tendril.functions import text
from tendril.functions.text import plain_text
from tendril.operators import facets, filters, lookups, more_readers, sentences, validation


def test_facets_as_brute_force(spark):
    draw = random.Random(1)
    rows = [(draw.random() < 0.7, draw.choice([None, 10, 200]), draw.choice([None, 5, 50]), [draw.choice("abc") for _ in range(draw.randint(0, 3))], draw.choice(["x", None])) for _ in range(200)]
    df = spark.createDataFrame(rows, "is_open boolean, amount int, experience int, places array<string>, kind string").withColumns({"amount": F.col("amount").cast("decimal(15,2)"), "experience": F.col("experience").cast("decimal(15,2)")})
    found = facets.listing_facets(df, filters.Filters(least="100", most_experience="20"), F.current_timestamp(), {"place": F.col("places"), "kind": F.col("kind")})
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    expected = Counter()
    for is_open, amount, experience, places, kind in rows:
        verdict = "no" if not is_open or (amount or 0) < 100 or (experience or 0) > 20 else "sin_leer" if experience is None else "si"
        for key in {(None, None), *(("place", p) for p in places), *([("kind", kind)] if kind else [])}:
            expected[key, "every"] += 1
            expected[key, verdict] += 1
    assert {(r["facet"], r["value"]): (r["found"], r["unread"], r["every"]) for r in found.collect()} == {k: (expected[k, "si"], expected[k, "sin_leer"], expected[k, "every"]) for k, _ in expected}


POST = {"cargo": "a", "meses": 3, "roles": ["x"], "nota": "", "si": True}
COLUMNS = (("cargo", validation.TEXT), ("meses", validation.WHOLE), ("roles", validation.LIST), ("nota", validation.OPTIONAL_TEXT), ("si", validation.TRUTH))


def test_the_first_fault_of_a_row_with_its_path(spark):
    cases = [
        (POST, None),
        (POST | {"cargo": "  "}, 'p 1: `cargo` must be text, got "  "'),
        (POST | {"meses": True}, "p 1: `meses` must be a whole number above 0, got true"),
        (POST | {"meses": 0}, "p 1: `meses` must be a whole number above 0, got 0"),
        (POST | {"roles": ["x", 1]}, 'p 1: `roles` must be a list of texts, not empty, got ["x",1]'),
        (POST | {"roles": "x"}, 'p 1: `roles` must be a list of texts, not empty, got "x"'),
        (POST | {"nota": None}, 'p 1: `nota` must be text, or "" where it does not apply, got null'),
        (POST | {"si": "true"}, 'p 1: `si` must be true or false, got "true"'),
        (POST | {"meses": 0, "cargo": ""}, 'p 1: `cargo` must be text, got ""'),
        ({}, "p 1: unknown columns [], missing columns [cargo, meses, nota, roles, si]"),
        ([1], "p 1: no table"),
    ]
    df = spark.createDataFrame([(k, "p", 1, json.dumps(row)) for k, (row, _) in enumerate(cases)] + [(99, "p", 1, None)], "k int, field string, number int, json string")
    found = {r["k"]: r["fault"] for r in validation.faults(df, ["k"], "field", "number", "json", {"p": COLUMNS}).collect()}
    assert found == {k: fault for k, (_, fault) in enumerate(cases) if fault} | {99: "p 1: no table"}


def running_brute(document, depth=3, share=0.5, least=3):
    pages = [p.split("\n") for p in document.split("\f")]
    if len(pages) < least:
        return document
    form = lambda line: re.sub("[0-9]+", "#", re.sub(r"\s+", "", plain_text(line)))
    beside = lambda line: m[1] if (m := re.search(r"\S( {4,}\S.*)$", line)) else ""
    seen = Counter()
    for lines in pages:
        solid = [x for x in lines if x.strip(" ")]
        edge = solid[:depth] + solid[::-1][:depth]
        seen.update({form(x) for x in edge} | {form(beside(x)) for x in edge} - {""})
    runs = {f for f, n in seen.items() if n >= max(least, math.ceil(len(pages) * share)) and f}
    out = []
    for lines in pages:
        gone = lambda x: not x.strip(" ") or form(x) in runs
        while lines and gone(lines[0]):
            lines = lines[1:]
        while lines and gone(lines[-1]):
            lines = lines[:-1]
        out.append("\n".join(x[: len(x) - len(beside(x))] if beside(x) and form(beside(x)) in runs and (i < depth or i >= len(lines) - depth) else x for i, x in enumerate(lines)))
    return "\f".join(out)


def test_running_lines_as_brute_force(spark):
    draw = random.Random(3)
    rows = []
    for k in range(150):
        head, foot, side = draw.choice(["Muni de X", "", "A 1"]), draw.random() < 0.6, draw.choice(["", "     LICITACIÓN N° 3"])
        page = lambda i: "\n".join([head, *(["", f" pág. {i}"] if draw.random() < 0.9 else []), *(draw.choice(["uno", "dos", f"línea {i}", "x" * i, ""]) + (side if draw.random() < 0.7 else "") for _ in range(draw.randint(0, 6))), *([f"  {i}  "] if foot else [])])
        rows.append((k, "\f".join(page(i) for i in range(draw.randint(1, 9)))))
    rows += [(1000, None), (1001, ""), (1002, "\f\f\f"), (1003, "a\f" * 400)]
    found = {r["k"]: r["clean"] for r in spark.createDataFrame(rows, "k int, t string").select("k", text.without_running_lines(F.col("t")).alias("clean")).collect()}
    assert found == {k: None if t is None else running_brute(t) for k, t in rows}


def nested(draw, depth=0):
    """A quotation with others in it, of kinds that can be told apart."""
    opening, closing = draw.choice([("«", "»"), ("“", "”"), ("„", "“")])
    inner = "".join(draw.choice(["palabra ", "obra ", "N 5 ", nested(draw, depth + 1) if depth < 3 else "x "]) for _ in range(draw.randint(3, 6)))
    return f"{opening}{inner if opening != '„' else inner.replace('“', '').replace('”', '').replace('„', '')}{closing}"


def test_the_outermost_quotation_is_found():
    draw = random.Random(5)
    for _ in range(500):
        whole, after = nested(draw), draw.choice([" y más", " con CUI 2719000", ""])
        body = f"de la obra: {whole}{after}"
        spans = more_readers.quotations(body, more_readers.PAIRED)
        assert (body.index(whole), body.index(whole) + len(whole) - 1) in spans


@pytest.mark.parametrize(
    "body, name",
    [
        ("obra correspondiente a [Ejecución de la IOARR “Renovación de Puente en el caserío (Chaquecyaco)”, con CUI N° 2661466”]", "Renovación de Puente en el caserío (Chaquecyaco)"),
        ("obra: [MEJORAMIENTO DE LA CARRETERA A PALTIC]", "MEJORAMIENTO DE LA CARRETERA A PALTIC"),
        ("obra: “MEJORAMIENTO DE LA I.E. “SAN MARTIN” DE PATAZ”, con CUI 2634231", "MEJORAMIENTO DE LA I.E. “SAN MARTIN” DE PATAZ"),
        ('obra: "MEJORAMIENTO DE LA I.E. "SAN MARTIN", DISTRITO DE PATAZ" con CUI 2634231', 'MEJORAMIENTO DE LA I.E. "SAN MARTIN", DISTRITO DE PATAZ'),
        ('obra: MEJORAMIENTO DE LAS AULAS Y PATIOS EN LA I.E. "SAN MARTIN DE PORRES", DISTRITO DE PATAZ, con CUI 2634231', 'MEJORAMIENTO DE LAS AULAS Y PATIOS EN LA I.E. "SAN MARTIN DE PORRES", DISTRITO DE PATAZ'),
        ("obra: �MEJORAMIENTO DEL CANAL HUANCHACO� con CUI 2634231", "MEJORAMIENTO DEL CANAL HUANCHACO"),
        ("obra “RENOVACION DE PUENTE EN LA VIA VECINAL, ANCASH. CON CUI: 2693255”", "RENOVACION DE PUENTE EN LA VIA VECINAL, ANCASH"),
        ("obra: “MEJORAMIENTO DEL CANAL «LA UNIÓN DE HUANCHACO, con CUI 2634231", "MEJORAMIENTO DEL CANAL «LA UNIÓN DE HUANCHACO"),
        ("obra: [ ]", None),
    ],
)
def test_names_of_works(body, name):
    assert more_readers.name_of(f"tiene por objeto la ejecución de la {body}") == name


def test_first_object(spark):
    cases = {'x {"a": {"b": 1}} y': '{"a": {"b": 1}}', "sin {llaves": None, '{"a": 1} y {"b": 2}': None, None: None, "": None, 'a\n{"k":\n[1, {"z": 2}]}\n': '{"k":\n[1, {"z": 2}]}'}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["o"] for r in df.select("t", lookups.first_object(F.col("t")).alias("o")).collect()} == cases


def test_sentences(spark):
    df = spark.createDataFrame([(Decimal("436482.01"), 1.0), (Decimal("1000.00"), 0.5), (Decimal("9.00"), 10.0)], "monto decimal(15,2), veces_cuantia double")
    assert [r["s"] for r in df.select(sentences.times_of_amount(F.struct("*")).alias("s")).collect()] == ["S/ 436,482.01 (1 vez la cuantía)", "S/ 1,000.00 (0.5 veces la cuantía)", "S/ 9.00 (10 veces la cuantía)"]
    notes = spark.createDataFrame([(None, "Consulta: a\n consulta: b\nno"), ([(True,), (False,)], "Consulta: z"), ([], None)], "rows array<struct<consulta:boolean>>, notes string")
    assert [r["n"] for r in notes.select(sentences.questions(F.col("rows"), F.col("notes")).alias("n")).collect()] == [2, 1, 0]
