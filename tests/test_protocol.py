"""Readers in one pass, as table functions, by version; chains over the files of documents."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tendril.operators import chain, factor_table, more_readers, personnel, protocol, readers
from tendril.operators.readers import SCANNED

ALL = [readers.AMOUNT, readers.EXPERIENCE, factor_table.FACTOR_READER, personnel.PERSONNEL, more_readers.OBJECT]

TEXT = """1.3 OBJETO DE LA CONVOCATORIA
 El procedimiento tiene por objeto la ejecución de la obra: “MEJORAMIENTO DEL CAMINO A PALTIC”, con CUI 2719000
1.4 CUANTÍA DE LA CONTRATACIÓN
 La cuantía asciende a S/ 1,000.00 (mil con 00/100 soles)
OBLIGACIONES
EXPERIENCIA DEL POSTOR EN LA ESPECIALIDAD
Requisitos:
un monto facturado acumulado equivalente a dos (2) veces la cuantía, durante los diez (10) años anteriores
Acreditación: x
B.2 EXPERIENCIA DEL PERSONAL CLAVE
Requisitos:
1. RESIDENTE DE OBRA
  Experiencia    24 meses
Acreditación: y
CUADRO RESUMEN DE LOS FACTORES DE EVALUACIÓN
 A. EXPERIENCIA ADICIONAL       60 puntos
 B. SOSTENIBILIDAD AMBIENTAL   40 puntos
PUNTAJE TOTAL   100 puntos
"""


def documents(spark):
    rows = [(1, TEXT, Decimal("1000.00"), "camino Paltic CUI 2719001"), (2, None, None, None), (3, "nada", Decimal("5.00"), ""), (4, TEXT.replace("1,000.00", "1,000.01") * 2, None, None)]
    return spark.createDataFrame(rows, "id long, text string, total decimal(15,2), said string")


def test_all_in_one_pass_as_each_alone(spark):
    docs = documents(spark)
    given = {"stated": F.col("total"), "amount": F.col("total"), "description": F.col("said")}
    found = protocol.read_all(docs, ALL, given=given)
    passes = lambda df: df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")
    assert passes(found.select("id", *(f"readings.{r.name}.{f}" for r in ALL for f in r.schema.names[:2]))) == 1
    assert passes(protocol.read_one(docs, ALL[0]).select("amount.page", "amount.amount", "amount.review")) == 1
    for r in ALL:
        alone = protocol.read_one(docs, r, given=given).select("id", r.name).orderBy("id").collect()
        both = found.select("id", F.col(f"readings.{r.name}").dropFields("version").alias(r.name)).orderBy("id").collect()
        assert both == alone
    first = found.orderBy("id").first()["readings"]
    assert first["amount"]["amount"] == Decimal("1000.00") and first["experience"]["amount"] == Decimal("2000.00")
    assert [p["months"] for p in first["personnel"]["staff"]] == [24] and first["factors"]["sum"] == 100
    assert first["object"]["name"] == "MEJORAMIENTO DEL CAMINO A PALTIC" and [w["warning"] for w in first["object"]["warnings"]] == ["cui_distinto_seace"]
    assert {n: first[n]["version"] for n in ("amount", "object")} == {"amount": readers.AMOUNT.version, "object": more_readers.OBJECT.version}


def test_rows_of_a_reader_joined_lateral(spark):
    documents(spark).createOrReplaceTempView("protocol_documents")
    protocol.rows_of(spark, factor_table.FACTOR_READER, "factors", "factor_rows")
    found = spark.sql("SELECT d.id, f.place, f.letter, f.points FROM protocol_documents d, LATERAL factor_rows(d.text) f ORDER BY 1, 2").collect()
    assert [tuple(r) for r in found] == [(1, 1, "A", 60), (1, 2, "B", 40), (4, 1, "A", 60), (4, 2, "B", 40)]


def test_versions_and_compared_fields(spark):
    docs = documents(spark)
    done = spark.createDataFrame([(1, "amount", readers.AMOUNT.version), (2, "amount", "amount-0"), (1, "object", more_readers.OBJECT.version)], "id long, reader string, version string")
    left = protocol.due(docs, done, [readers.AMOUNT, more_readers.OBJECT], "id")
    assert sorted((r["id"], r["reader"]) for r in left.collect()) == [(2, "amount"), (2, "object"), (3, "amount"), (3, "object"), (4, "amount"), (4, "object")]
    name = lambda text: "tiene por objeto la obra: “" + text + "”"
    rows = [("AMPLIACIÓN DEL SERVICIO DE AGUA", "AMPLIACION DEL SERVIC IO DE AGUA"), ("RENOVACIÓN DE PUENTE VIEJO", "RENOVAC CISCO DE SUCRE"), ("RENOVACIÓN DE PUENTE VIEJO", None)]
    pair = spark.createDataFrame([(k, "objeto de la convocatoria " + name(a), "objeto de la convocatoria " + name(b) if b else "") for k, (a, b) in enumerate(rows)], "k int, a string, b string")
    both = protocol.read_one(protocol.read_one(pair, more_readers.OBJECT, "a", name="one"), more_readers.OBJECT, "b", name="two")
    assert [r["d"] for r in both.select("k", protocol.compared(more_readers.OBJECT, F.col("one"), F.col("two")).alias("d")).orderBy("k").collect()] == [[], ["name"], None]


# --- chains -------------------------------------------------------------------------------------------------------

PLENTY = "palabras de relleno para una página que no es imagen " * 12  # over 400 characters
LITTLE = "texto de una página con imagen, que no es un escaneo porque tiene más de ochenta caracteres en ella. "


def holds(amount, around=LITTLE):
    return f"{around}1.4 CUANTÍA DE LA CONTRATACIÓN\nLa cuantía asciende a S/ {amount}\nOBLIGACIONES\n"


def chained(spark, files, ocr=True, docs=(1,)):
    """files: (document, file, name, kind, text)."""
    rows = [(*f, "roto" if f[4] is None else None) for f in files]
    table = spark.createDataFrame(rows, "doc long, file int, name string, kind string, text string, error string")
    found = chain.read_documents(spark.createDataFrame([(d,) for d in docs], "doc long"), table, readers.AMOUNT, "doc", ocr=ocr)
    return {r["doc"]: r for r in found.collect()}


def shown(row):
    return (row["amount"] and str(row["amount"]["amount"]), row["name"], row["source"], row["second"], row["review"], row["looked"])


def test_text_before_copies_and_no_further_than_the_first_hit(spark):
    files = [(1, 1, "a.pdf", "text", PLENTY), (1, 2, "b.pdf", "text", holds("7.00")), (1, 3, "c.pdf", "text", holds("9.00")), (1, 1, "a.pdf", "model", holds("8.00"))]
    assert shown(chained(spark, files)[1]) == ("7.00", "b.pdf", "text", None, None, 2)


@pytest.mark.parametrize(
    "model, ocr, allowed, expected",
    [
        (holds("5.00"), holds("5.00"), True, ("5.00", "BASES.pdf", "model", [], None, 1)),
        (holds("5.00"), holds("5.50"), True, ("5.00", "BASES.pdf", "model", ["amount"], None, 1)),
        (holds("5.00"), LITTLE, True, ("5.00", "BASES.pdf", "model", None, None, 1)),
        (holds("5.00"), holds("5.50"), False, ("5.00", "BASES.pdf", "model", None, None, 1)),
        (holds("5.00"), None, True, ("5.00", "BASES.pdf", "model", None, None, 1)),
        (LITTLE, holds("6.00"), True, ("6.00", "BASES.pdf", "ocr", None, None, 2)),
        (LITTLE, None, False, (None, None, None, None, readers.NO_SECTION, 1)),
        ("", LITTLE, True, (None, None, None, None, readers.NO_SECTION, 2)),
        ("", None, True, (None, "BASES.pdf", None, None, SCANNED, 1)),
        (LITTLE, None, True, (None, None, None, None, "ilegible: BASES.pdf: roto", 1)),
    ],
)
def test_copies_of_a_scan(spark, model, ocr, allowed, expected):
    files = [(1, 1, "BASES.pdf", "text", "sello"), (1, 1, "BASES.pdf", "model", model), (1, 1, "BASES.pdf", "ocr", ocr)]
    assert shown(chained(spark, files, allowed)[1]) == expected


def test_every_model_copy_but_two_by_ocr_those_named_bases_first(spark):
    files = [(d, n, "bases.pdf" if n == 4 else f"anexo {n}.pdf", "text", "") for d in (1, 2, 3, 4) for n in range(1, 5)]
    files += [(1, n, "", "model", holds("7.00") if n == 3 else LITTLE) for n in range(1, 5)]
    files += [(2, n, "", "ocr", holds("7.00") if n == 2 else LITTLE) for n in range(1, 5)]
    files += [(3, n, "", "ocr", holds(f"{n}.00")) for n in range(1, 5)]
    found = chained(spark, files, docs=(1, 2, 3, 4, 5))
    assert shown(found[1]) == ("7.00", "anexo 3.pdf", "model", None, None, 4)
    assert shown(found[2]) == (None, "anexo 2.pdf", None, None, SCANNED, 2)  # the second, third and fourth in turn; two are read
    assert shown(found[3]) == ("4.00", "bases.pdf", "ocr", None, None, 1)
    assert shown(found[4]) == (None, "anexo 1.pdf", None, None, SCANNED, 0)
    assert shown(found[5]) == (None, None, None, None, chain.NO_FILES, 0)
    assert {d: r["deferred"] for d, r in chained(spark, files, False, (1, 2, 5)).items()} == {1: False, 2: True, 5: False}


def test_every_copy_by_ocr_where_no_number_is_given(spark):
    files = [(d, n, f"anexo {n}.pdf", "text", "") for d in (1, 2) for n in range(1, 71)]
    files += [(d, n, "", "ocr", holds("7.00") if (d, n) == (1, 70) else LITTLE) for d in (1, 2) for n in range(1, 71)]
    table = spark.createDataFrame([(*f, None) for f in files], "doc long, file int, name string, kind string, text string, error string")
    docs = spark.createDataFrame([(1,), (2,)], "doc long")
    found = {r["doc"]: r for r in chain.read_documents(docs, table, readers.AMOUNT, "doc", ocr_files=None).collect()}
    assert shown(found[1]) == ("7.00", "anexo 70.pdf", "ocr", None, None, 70)
    assert shown(found[2]) == (None, None, None, None, readers.NO_SECTION, 70)


def test_the_query_of_the_chain_reads_a_third_copy_by_ocr(spark, data):
    from tendril import catalog

    row = catalog.QUERIES["chain_of_files"](spark, data).filter("nid = 11").collect()[0]
    assert row["amount"] is not None and (row["name"], row["source"], row["review"], row["looked"]) == ("anexo 3.pdf", "ocr", None, 3)


def test_an_image_after_150_pages(spark):
    files = [(1, 1, "a.pdf", "text", "\f".join([PLENTY] * 200 + [LITTLE])), (1, 1, "a.pdf", "ocr", holds("7.00"))]
    assert shown(chained(spark, files)[1]) == ("7.00", "a.pdf", "ocr", None, None, 2)


def brute(files, document, ocr):
    """The chain file by file."""
    own = sorted((f for f in files if f[0] == document and f[3] == "text"), key=lambda f: f[1])
    copy = {(f[1], f[3]): f[4] for f in files if f[0] == document}
    solid = lambda t: [len("".join(p.split())) for p in t.split("\f")]
    scan = lambda t: sum(n < 80 for n in solid(t)) >= 0.8 * len(solid(t))
    hit = lambda t: readers.read_amount_of(t)["review"] != readers.NO_SECTION
    looked, scans, images, broken = 0, [], [], []
    for _, n, name, _, text in own:
        if text is None:
            broken.append(name)
            continue
        if scan(text):
            scans.append(n)
        else:
            looked += 1
            if hit(text):
                return name, "text", looked, None
        if min(solid(text)) < 400:
            images.append((n, name))
    for turn, (n, name) in enumerate(sorted(images, key=lambda f: "BASE" not in f[1].upper())):
        for kind in ("model", "ocr"):
            text = copy.get((n, kind))
            if kind == "ocr" and (not ocr or turn > 1):
                continue
            if text is None:
                broken += [name] if (n, kind) in copy and kind == "ocr" else []
                continue
            looked += 1
            if hit(text):
                return name, kind, looked, None
            if not scan(text):
                scans = [s for s in scans if s != n]
    names = {f[1]: f[2] for f in own}
    return (names[min(scans)] if scans else None), None, looked, SCANNED if scans else "ilegible: " + "; ".join(f"{b}: roto" for b in broken) if broken else chain.NO_FILES if not own else readers.NO_SECTION


@pytest.mark.parametrize("seed", range(3))
def test_as_file_by_file(spark, seed):
    draw = random.Random(seed)
    text = lambda: draw.choice([None, "", "sello", LITTLE, PLENTY, LITTLE, holds("1.00"), holds("2.00", PLENTY), "a\f" + PLENTY])
    files = []
    for d in range(40):
        for n in range(1, draw.randint(1, 6)):
            name = draw.choice(["anexo", "BASES", "Bases int"]) + f" {n}.pdf"
            files.append((d, n, name, "text", text()))
            files += [(d, n, name, k, text()) for k in ("model", "ocr") if draw.random() < 0.6]
    allowed = seed != 1
    found = chained(spark, files, allowed, range(40))
    for d in range(40):
        r = found[d]
        assert (r["name"], r["source"], r["looked"], r["review"]) == brute(files, d, allowed), d


def test_long_documents_are_dealt_over_tasks(spark, monkeypatch):
    files = [(1, n, f"{n}.pdf", "text", holds(f"{n}.00", PLENTY) if n in (150, 170) else PLENTY) for n in range(1, 201)]
    assert shown(chained(spark, files)[1])[:3] == ("150.00", "150.pdf", "text")
