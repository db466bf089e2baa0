"""Small cases of what the catalog's queries do not show: empty and null input, and the guards of reads."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tendril.functions import spanish
from tendril.operators import factor_table, limits, records, requirements, state
from tendril.sources.portal import document_list


def test_document_list():
    every = list(range(7))
    page = lambda first: every[first : first + 3]
    assert document_list(every[:3], 7, page) == every
    assert document_list(every[:3], 3, lambda _: pytest.fail("nothing to ask for")) == every[:3]
    with pytest.raises(ValueError, match="another"):
        document_list(every[:3], 7, lambda first: page(first + 1))
    with pytest.raises(ValueError, match="7 documents read, 9 stated"):
        document_list(every[:3], 9, page)


def test_words_beside():
    texts = [
        "S/ 1,200.50 (mil doscientos con 50/100 soles)",
        "S/ 1,200.50) [mil doscientos con 50/100 soles]",
        "la suma de mil doscientos con 50/100 soles (S/ 1,200.50)",
        "S/ 1,200.50 (incluido el impuesto de ley)",
        "S/ 1,200.50",
        None,
    ]
    assert [spanish.words_beside(t, limits.NUMBER) for t in texts] == ["mil doscientos con 50/100 soles"] * 3 + [None] * 3


def test_first_amount_in_words():
    assert spanish.first_amount_in_words("(sin nada aqui) (doscientos soles) (dos mil con 10/100 soles) (tres mil soles)") == Decimal("2000.10")
    assert spanish.first_amount_in_words("") is None


def test_limits_without_a_table():
    assert limits.limits(None) is None and limits.limits("LÍMITE INFERIOR\nLÍMITE SUPERIOR") is None
    assert set(limits.limits("LÍMITE INFERIOR    LÍMITE SUPERIOR").values()) == {None}


def test_total_over_the_words():
    """The figure on the line above the words for the total, and `puntos` below."""
    rows = "CUADRO RESUMEN DE LOS FACTORES DE EVALUACIÓN\nA. INTEGRIDAD   100 puntos\n   100\nPUNTAJE TOTAL\npuntos\n"
    assert factor_table.read_text(rows)[2:4] == (100, 100)
    assert factor_table.read_text(None)[-1] == factor_table.read_text("")[-1] == factor_table.NO_TABLE


def test_second_summary_is_read_if_the_first_has_no_rows():
    text = "RESUMEN DE FACTORES DE EVALUACIÓN ... 12\nPUNTAJE TOTAL 3 puntos\n\x0cRESUMEN DE FACTORES DE EVALUACIÓN\nA. CALIDAD  100 puntos\nPUNTAJE TOTAL  100 puntos"
    assert factor_table.read_text(text)[2:4] == (100, 100)


def test_chapters_of_nothing(spark):
    df = spark.createDataFrame([(None,), ("",), ("CAPÍTULO IV",)], "text string")
    assert [r["chapters"]["review"] for r in requirements.find_chapters(df).collect()] == [requirements.NOT_FOUND] * 3
    assert requirements.find_chapters(df.limit(0)).count() == 0


def test_import(spark):
    stored = spark.createDataFrame([(1, "a", True), (2, "b", True), (3, "c", True)], "k int, fields string, reported boolean")
    filled = spark.createDataFrame([(1, "a", True), (2, "x", True), (4, "new", True), (5, "wait", False), (6, "lost", True), (7, "null", None)], "k int, fields string, ready boolean")
    after, refused = records.import_ready(filled, spark.createDataFrame([(k,) for k in (1, 2, 2, 3, 4, 5, 7)], "k int"), stored, ["k"], "fields", "reported")
    assert sorted(map(tuple, after.collect())) == [(1, "a", True), (2, "x", None), (3, "c", True), (4, "new", None)]
    assert [r["k"] for r in refused.collect()] == [6]


def test_deadline_without_stage(spark):
    changes = spark.createDataFrame([(1, "deadline"), (1, "state"), (2, "deadline")], "k int, field string")
    left = state.without_echo(changes, "deadline", spark.createDataFrame([(1,), (1,)], "k int"), ["k"])
    assert sorted(map(tuple, left.select("k", "field").collect())) == [(1, "state"), (2, "deadline")]
