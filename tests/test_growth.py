"""What keeps the cost of a row small, and its rows over all cores, as the plans show it."""

import re
from time import perf_counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tendril import catalog
from tendril.functions import memo, spanish, text
from tendril.operators import factor_table, more_readers, personnel, protocol, readers, validation


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_fault_is_looked_for_once_and_without_paths_made_of_columns(spark):
    df = spark.createDataFrame([(1, "cuantia", 1, "{}")], "k int, field string, number int, json string")
    shown = plan(validation.faults(df, ["k"], "field", "number", "json", {"cuantia": validation.AMOUNT_BLOCK}))
    assert shown.count("unknown columns") == 2  # of a row and of a step
    assert shown.count("concat($., ") == 1  # the tag's


def test_rows_of_record_faults_are_dealt(spark, data):
    assert "RepartitionByExpression [p_partkey" in plan(catalog.QUERIES["record_faults"](spark, data))


def test_a_line_has_its_form_computed_once(spark, data):
    made = spark.createDataFrame([("a",)], "x string").select(text.without_running_lines(F.col("x")))
    assert plan(made).count("translate(lower(") == 6
    assert "RepartitionByExpression [c_custkey" in plan(catalog.QUERIES["running_lines"](spark, data))


def test_values_of_records_are_not_broadcast(spark, data):
    shown = catalog.QUERIES["incongruence_faults"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in shown and shown.count("SortMergeJoin") == 3


def test_words_are_not_looked_for_without_brackets():
    block = "asciende a S/ 1,234,567.89" + " " * 40 + "con IGV 1,234,567.89 " * 25

    def seconds():
        start = perf_counter()
        assert all(spanish.words_beside(block, readers.NUMBER) is None for _ in range(1000))
        return perf_counter() - start

    assert min(seconds() for _ in range(3)) < 0.05
    assert spanish.words_beside("S/ 1,200.00 (mil doscientos soles)", readers.NUMBER) == "mil doscientos soles"


def test_wording_that_comes_again_is_read_once(monkeypatch):
    calls = []
    for module, name in ((personnel, "times"), (factor_table, "table_rows"), (readers, "years_word")):
        monkeypatch.setattr(module, name, lambda *a, real=getattr(module, name), name=name: calls.append(name) or real(*a))
    posts = "B.2 EXPERIENCIA DEL PERSONAL CLAVE\nRequisitos:\n1. RESIDENTE DE OBRA\n  Experiencia    37 meses\nAcreditación: y\n"
    table = "CUADRO RESUMEN DE LOS FACTORES DE EVALUACIÓN\n A. EXPERIENCIA ADICIONAL       63 puntos\n B. SOSTENIBILIDAD AMBIENTAL   37 puntos\nPUNTAJE TOTAL   100 puntos\n"
    asked = "EXPERIENCIA DEL POSTOR EN LA ESPECIALIDAD\nRequisitos:\nun monto facturado equivalente a dos (2) veces la cuantía, durante los doce (12) años anteriores\nAcreditación: x\n"
    for n in range(1, 20):
        text = f"Tender {n}\f{asked}{posts}{table}"
        assert personnel.read_personnel_of(text)["staff"] == [{"post": "RESIDENTE DE OBRA", "time": "37 meses", "months": 37}]
        assert [f["points"] for f in factor_table.read_factors_of(text)["factors"]] == [63, 37]
        assert readers.read_experience_of(text, n)["amount"] == 2 * n
    assert sorted(calls) == ["table_rows", "times", "years_word"]


@pytest.mark.parametrize("text", ["", "objeto", "un OBJETO  de\nla convocatoria, objeto de la convocatoria", "İ objeto de la convocatoria", "ıſK objeto de la convocatoria objeto"])
def test_places_of_words_are_those_of_their_patterns(text):
    for pattern, word, ahead in ((r"objeto\s+de\s+la\s+convocatoria", "objeto", 0), (r"bjeto\b", "jeto", 1)):
        p = re.compile(pattern, re.I)
        for begin, end in ((0, len(text)), (3, 20), (1, 10_000)):
            assert [m.span() for m in memo.matches(p, word, text, begin, end, ahead)] == [m.span() for m in p.finditer(text, begin, end)]


def test_a_wide_gap_is_looked_at_once():
    line = "x" + " " * 2000 + "y" * 400

    def seconds(text):
        start = perf_counter()
        assert more_readers.without_page_edges(text) == text
        return perf_counter() - start

    assert min(seconds(line) for _ in range(3)) < 0.05
    assert more_readers.without_page_edges("a" + " " * 9 + "b     LICITACIÓN 3\nc") == "a\nc"


def test_pages_after_the_section_of_the_object_are_not_looked_at(monkeypatch):
    looked = []

    class Counting:
        search = staticmethod(lambda line, real=more_readers._EDGE: looked.append(line) or real.search(line))

    monkeypatch.setattr(more_readers, "_EDGE", Counting)
    head = "1.3 OBJETO DE LA CONVOCATORIA\n El procedimiento tiene por objeto la obra: “MEJORAMIENTO DEL CAMINO A”, con CUI 2345678\n"
    pages = ["\n1.4 CUANTÍA\nuno\n", *("dos\ntres\n" for _ in range(50))]
    read = more_readers.read_object_of(head + "\f".join(["", *pages]))
    assert (read["name"], read["code"], read["review"]) == ("MEJORAMIENTO DEL CAMINO A", "2345678", None)
    assert len(looked) <= 6


def test_a_running_header_over_a_page_break_leaves_the_section_as_it_is():
    # what stands beside the text goes with the break, so the second page is the last one, whose lower edge stays
    text = "tiene por objeto la obra x     a\fb LICITACIÓN 3\n\f1.4\n12\n\n1.4 y"
    pages = "tiene por objeto la obra x\n1.4\n12\n\n1.4 y"
    assert more_readers.without_page_edges(text) == pages
    assert more_readers.object_section(text) == "tiene por objeto la obra x"


def test_records_of_few_texts_are_python_objects_at_a_time(spark, monkeypatch):
    sizes = []
    together = lambda records: sizes.append(len(records[0])) or pa.array(["x"] * len(records[0]))
    monkeypatch.setattr(F, "arrow_udf", lambda function, schema: lambda *columns: function)
    run = protocol._crossing([readers.AMOUNT], "text", {"stated": F.lit(1)}, readers.AMOUNT.schema, together)
    out = [*run(iter([(pa.array(["a"] * 1001), pa.array([None] * 1001)), (pa.array([], "string"), pa.array([], "string"))]))]
    assert [len(x) for x in out] == [1001, 0] and max(sizes) == protocol.TEXTS


def test_a_spread_join_has_one_form_with_and_without_hot_keys(spark):
    from tendril.llm.common import spread_join

    left, right = spark.range(100).select((F.col("id") % 7).alias("k"), "id"), spark.range(7).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    joined = spread_join(left, right, ["k"], None, "id")
    keys = [line for line in plan(joined).split("\n") if "Join" in line]
    assert len(keys) == 1 and "_part" in keys[0]
    assert joined.count() == 100 and joined.columns == ["k", "id", "v"]
