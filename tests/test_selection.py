"""What is to be done next, and the page of a tender."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from tendril.operators import detail, protocol, readers, selection

DOCUMENTS = "doc long, tender long, type string, path string, state string, published timestamp, unpacked string"
CONTENTS, READINGS = "doc long, content int, path string, error string", "doc long, version string, at int, amount decimal(15,2)"


def made(seed):
    draw = random.Random(seed)
    day = lambda: draw.choice([None, datetime(2025, 1, 1) + timedelta(days=draw.randrange(5))])
    documents = [(d, draw.randrange(12), draw.choice(["Bases Administrativas", "BASES INTEGRADAS", "Acta"]), draw.choice(["a.pdf", "b.ZIP", "c.rar", None]), draw.choice(["done", "done", "pending"]), day(), draw.choice([None, "done", "broken"])) for d in range(60)]
    contents = [(draw.randrange(60), k, draw.choice([f"f{k}", f"f{k}", None]), draw.choice([None, None, "bad"])) for k in range(80)]
    readings = [(draw.randrange(60), draw.choice(["amount-1", "amount-2", "object-2"]), k, Decimal(k)) for k in range(90)]
    return documents, contents, readings


def brute(documents, contents, readings, version):
    bases = [d for d in documents if d[4] == "done" and d[2].lower().startswith("bases")]
    newest = {}
    for d in bases:
        rank = ("integrad" in d[2].lower(), d[5] is not None, d[5] or datetime(1, 1, 1), d[0])
        newest[d[1]] = max(newest.get(d[1], rank), rank)
    out = set()
    for d in bases:
        archive = (d[3] or "").lower().endswith((".zip", ".rar", ".7z"))
        if archive and d[6] is None or any(r[0] == d[0] and r[1] == version for r in readings):
            continue
        files = [c[2] for c in sorted(contents, key=lambda c: c[1]) if c[0] == d[0] and c[2] and not c[3]]
        own = [r for r in readings if r[0] == d[0] and r[1].startswith("amount-")]
        out.add((d[0], newest[d[1]][3] == d[0], ",".join(files), max(own, key=lambda r: r[2])[3] if own else None))
    return out


def test_bases_to_read_as_brute_force(spark):
    for seed in range(3):
        documents, contents, readings = made(seed)
        found = selection.bases_to_read(spark.createDataFrame(documents, DOCUMENTS), spark.createDataFrame(contents, CONTENTS), spark.createDataFrame(readings, READINGS), "amount-2")
        assert {(r["doc"], r["newest"], ",".join(r["contents"]), r["amount"]) for r in found.collect()} == brute(documents, contents, readings, "amount-2")


def test_queues_and_pending(spark):
    documents = spark.createDataFrame([(k, "f" if k % 3 else None) for k in (5, 3, 9, 4, 7)], "doc long, todo_kind string")
    assert sorted((r["doc"], r["place"]) for r in selection.queue(documents, F.col("todo_kind")).collect()) == [(4, 1), (5, 2), (7, 3)]
    tenders = [(1, ["LIMA"], None, 5), (2, ["Áncash"], None, None), (3, [], None, 1), (4, None, None, 1), (5, ["PUNO"], None, 0), (6, ["ancash"], 1, 0), (7, ["ANCASH", "PUNO"], None, None)]
    df = spark.createDataFrame(tenders, "nid long, regions array<string>, reported int, days int")
    found = {r["nid"]: r["place"] for r in selection.pending(df, ["Ancash", "lima"], F.col("days"), "nid").collect()}
    assert found == {3: 1, 4: 2, 1: 3, 2: 4, 7: 5}
    assert selection.pending(df.limit(0), ["x"], F.col("days"), "nid").count() == 0


def test_the_page_of_a_tender(spark):
    text = "1.4 CUANTÍA DE LA CONTRATACIÓN\nLa cuantía asciende a S/ 1,000.00 (dos mil con 00/100 soles)\nOBLIGACIONES\nen el presente procedimiento de selección es: FIJA"
    rows = [(1, 10, "BASES N° 1.pdf", text, "text"), (2, 11, "b.docx", text, "ocr"), (3, None, None, None, None), (4, 12, "c.pdf", None, "text")]
    df = protocol.read_one(spark.createDataFrame(rows, "nid long, document long, file string, text string, source string"), readers.AMOUNT)
    record = F.when(F.col("nid") < 4, F.col("amount"))
    found = detail.notes(df, "nid", "document", "file", {"amount": record}, F.col("source"), {"amount": F.when(F.col("nid") == 2, F.array(F.lit("limits")))}).orderBy("nid", "place").collect()
    words = "La cuantía en cifras (S/ 1,000.00) no es la que dicen las letras (S/ 2,000.00)."
    assert [tuple(r) for r in found] == [
        (1, "consultar", 1, words, 1, "/obras/1/bases/10/BASES%20N%C2%B0%201.pdf#page=1"),
        (2, "mirar", 1, words, None, "/obras/2/bases/11/b.docx"),
        (2, "mirar", 2, "Las dos lecturas del escaneo no coinciden en limits. Mirar la página.", None, "/obras/2/bases/11/b.docx"),
        (3, "revisar", 1, detail.NOT_FETCHED, None, None),
        (4, "revisar", 1, detail.NOT_READ, None, None),
    ]
