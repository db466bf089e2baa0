from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tendril.functions import amounts, dates, places, spanish, text


def value(spark, column, **inputs):
    row = spark.createDataFrame([tuple(inputs.values())], list(inputs)) if inputs else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "written, expected",
    [("S/ 1,234,567.89", "1234567.89"), ("1'234'567,89", "1234567.89"), ("1 234 567.89", "1234567.89"), ("2.500.000", "2500000.00"), ("S/. 1´000´000.50", "1000000.50"), ("0.75", "0.75"), ("nada", None)],
)
def test_money(spark, written, expected):
    assert value(spark, amounts.money(F.col("x")), x=written) == (expected and Decimal(expected))


def test_limits_round_inwards(spark):
    amount = F.lit("127019.94").cast(amounts.MONEY)
    assert value(spark, amounts.lower_limit(amount)) == Decimal("120668.95")
    assert value(spark, amounts.upper_limit(amount)) == Decimal("139721.93")


def test_typed_and_portal_amounts(spark):
    assert value(spark, amounts.typed_amount(F.col("x")), x="S/ 1,000.5") == Decimal("1000.50")
    assert value(spark, amounts.typed_amount(F.col("x")), x="-5") is None
    assert value(spark, amounts.portal_amount(F.col("x")), x="---") is None
    assert value(spark, amounts.portal_amount(F.col("x")), x="1,234.00") == Decimal("1234.00")


def test_ratio_is_half_even(spark):
    assert value(spark, amounts.ratio(F.lit(10005).cast("decimal(15,2)"), F.lit(10000).cast("decimal(15,2)"))) == Decimal("1.000")


def test_nearest(spark):
    found = amounts.nearest(F.array(F.lit(10), F.lit(14), F.lit(30)), F.lit(13), F.lit(5))
    assert value(spark, found) == 14
    assert value(spark, amounts.nearest(F.array(F.lit(30)), F.lit(13), F.lit(5))) is None


@pytest.mark.parametrize(
    "words, number",
    [("mil doscientos treinta y cinco", 1235), ("dos millones quinientos mil", 2_500_000), ("veintiún mil", 21_000), ("cinco tres", None), ("doscient0s", 200), ("trescientas", 300), ("xyz", None), ("un millón", 1_000_000), ("", None)],
)
def test_number_words(words, number):
    assert spanish.word_number(words) == number


def test_amount_words():
    assert spanish.word_amount("ciento veinte mil cuatrocientos con 50/100 soles") == Decimal("120400.5")
    assert spanish.years_word("diez (10) años") == 10
    assert spanish.years_word("clnco años") == 5


def test_text(spark):
    assert value(spark, text.normalize(F.col("x")), x="  Straße\tﬁn  ÉÑ ") == "strasse fin en"
    assert value(spark, text.plain(F.col("x")), x="Ñandú Straße") == "nandu straße"
    assert value(spark, text.tidy(F.col("x")), x="¿Obra de(l) agua ; y luz ,") == "Obra de(l) agua, y luz"
    assert value(spark, text.place(F.col("x")), x="MUNICIPALIDAD DISTRITAL DE SAN JUAN DE LA VIRGEN") == "San Juan de la Virgen"
    assert value(spark, text.join_words(F.array(F.lit("a"), F.lit("b"), F.lit("c")))) == "a, b y c"
    assert value(spark, text.page_ranges(F.array(*map(F.lit, (1, 2, 3, 7))))) == "1-3,7"
    assert value(spark, text.span(F.lit("x"), F.lit("x"))) == "x"
    assert value(spark, text.span(F.lit("x"), F.lit("y"))) == "x al y"
    assert value(spark, text.span(F.lit(""), F.lit(None).cast("string"))) is None
    assert value(spark, text.cell_text(F.col("x")), x="<td>a &amp; <b>b</b><script>no</script>\n c</td>") == "a & b c"
    assert value(spark, text.letters_plain(F.col("x")), x="m!l") == "mil"
    assert value(spark, text.without_uuid(F.col("x")), x="0f8fad5b-d9cb-469f-a165-70867728950e_bases.pdf") == "bases.pdf"
    assert value(spark, text.work_name(F.col("x")), x="Ejecución de la obra: MEJORAMIENTO DEL CAMINO, con CUI N° 2345678") == "MEJORAMIENTO DEL CAMINO"


def test_references_without_their_end(spark):
    html = "<b>a&amp</b> &amp;lt; &copy; &#233; &#xe9; &notit; &nichts; &lt"
    assert value(spark, text.cell_text(F.col("x")), x=html) == "a& &lt; © é é ¬it; &nichts; <"
    assert value(spark, text.cell_text(F.col("x"), closed=True), x=html) == "a&amp &lt; © é é &notit; &nichts; &lt"


def test_sentence_case(spark):
    sentence = text.sentence_case(("LIMA",))
    assert value(spark, sentence(F.col("x")), x="CREACION DEL PARQUE II EN LIMA") == "Creacion del parque II en Lima"
    assert value(spark, sentence(F.col("x")), x="Ya escrito") == "Ya escrito"


def test_paged_text(spark):
    paged = "uno\x0cdos\x0ctres"
    assert value(spark, text.page_of(F.col("x"), F.lit(5)), x=paged) == 2
    assert value(spark, text.scanned_share(F.col("x")), x=paged) == 1.0
    assert value(spark, text.image_pages(F.col("x")), x=paged) == [1, 2, 3]
    assert value(spark, text.marked_pages(F.col("x"), 12), x=paged) == "[p. 1]\nuno\n["


def test_dates(spark):
    when = dates.parse_portal(F.col("x"))
    assert str(value(spark, when.cast("timestamp_ntz"), x="31/12/2024")) == "2025-01-01 04:59:00"
    assert str(value(spark, dates.lima_date(when), x="31/12/2024 23:30")) == "2024-12-31"
    assert value(spark, dates.months_of(F.col("x")), x="TRES (3) años") == 36
    assert value(spark, dates.closing_bucket(F.lit(6))) == "semana"
    assert value(spark, dates.long_date(F.lit("2000-01-03").cast("date"))) == "lunes 3 de enero de 2000"


def test_places(spark):
    assert value(spark, places.located(F.col("x")), x="vía en el Departamento de La Libertad, calle Lima")["regions"] == ["LA LIBERTAD"]
    assert value(spark, places.located(F.col("x")), x="pistas en Av. Cusco y Jr. Puno")["source"] == "unknown"
    assert value(spark, places.located(F.col("x")), x="camino de Cusco a Puno")["regions"] == ["CUSCO", "PUNO"]
    entity = places.placed(F.col("x"), F.col("e"), F.col("s"))
    assert value(spark, entity, x="pistas del barrio", e="Municipalidad Distrital de X", s="Áncash").asDict() == {"regions": ["ANCASH"], "source": "entity"}
    assert value(spark, entity, x="en la región Cusco", e="Municipalidad de X", s="Puno")["source"] == "text"
