import io
import zipfile
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tendril.sinks import reports
from tendril.sources import pages, portal, ranges

SEARCH = "<table><tr><th>N&deg;</th><th>Entidad</th><th> Descripci&oacute;n </th></tr><tr><td>1</td><td>A &amp; B</td><td>x<script>no</script> <b>y</b></td></tr><tr><td>2</td><td></td><td>z</td></tr></table>"


def test_table_by_headers(spark):
    files = spark.createDataFrame([("p", SEARCH), ("q", None)], "path string, value string")
    rows = pages.read_tables(files, {"ENTIDAD": "entity", "Descripcion": "description"}).orderBy("place").collect()
    assert [tuple(r) for r in rows] == [("p", 0, "A & B", "x y"), ("p", 1, None, "z")]
    with pytest.raises(ValueError, match="no table"):
        pages.table_rows(SEARCH, {"Monto": "amount"})


def stages(*rows):
    return "<table><tr><th>Etapa</th><th>Fecha Inicio</th><th>Fecha Fin</th></tr>" + "".join(f"<tr><td>{a}</td><td>{b}</td><td>{c}</td></tr>" for a, b, c in rows) + "</table>"


def test_schedule():
    found = pages.schedule(stages(("Convocatoria", "01/01/2025", "01/01/2025"), ("Ofertas", "02/01/2025", "")))
    assert [(r["place"], r["stage"], r["ends"]) for r in found] == [(1, "Convocatoria", "01/01/2025"), (2, "Ofertas", None)]
    with pytest.raises(ValueError):
        pages.schedule(stages(("A", "", ""), ("A", "", "")))
    with pytest.raises(ValueError):
        pages.schedule(stages())
    assert pages.schedule(stages((pages.NO_STAGES, "", ""))) == []


def test_states(spark):
    html = '<span class="estado-item"><b>Convocado</b></span> x <span class="estado-item">Desierto</span>'
    assert spark.createDataFrame([(html,)], "h string").select(pages.states(F.col("h"))).first()[0] == ["Convocado", "Desierto"]


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in members.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), content)
    return out.getvalue()


def test_archives(spark):
    inner = zipped(c_dot_pdf=b"123")
    outer = zipped(a_dot_pdf=b"1", sub__b_dot_zip=inner) + b""
    evil = io.BytesIO()
    with zipfile.ZipFile(evil, "w") as z:
        z.writestr("../x", b"1")
    files = spark.createDataFrame([("one", bytearray(outer)), ("bad", bytearray(b"no zip")), ("evil", bytearray(evil.getvalue()))], "path string, content binary")
    rows = {(r["path"], r["member"], r["inside"], r["error"]) for r in pages.read_archives(files).collect()}
    assert rows == {("one", "a.pdf", "", None), ("one", "sub/b.zip", "", None), ("one", "c.pdf", "sub/b.zip", None), ("bad", "", "", "unreadable"), ("evil", "../x", "", "outside")}


def test_docx_and_toml(spark):
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>uno</w:t></w:p><w:p><w:t>dos</w:t></w:p>")
    files = spark.createDataFrame([("d", bytearray(content.getvalue()))], "path string, content binary")
    assert pages.with_python(files, "content", pages.docx_text).first()["text"] == "uno\ndos\n"
    texts = spark.createDataFrame([("t", "a = 1\n[b]\nc = 'x'"), ("u", "= broken")], "path string, value string")
    assert {r["path"]: r["json"] for r in pages.toml_records(texts).collect()} == {"t": '{"a": 1, "b": {"c": "x"}}', "u": None}


class Backend:
    def __init__(self, per_day, lie=0):
        self.rows = [{"nid": i, "day": date(2025, 1, 1) + timedelta(days=i // per_day)} for i in range(per_day * 20)]
        self.lie = lie

    def between(self, a, b):
        return [r for r in self.rows if a <= r["day"] <= b]

    def count(self, a, b):
        return len(self.between(a, b)) + self.lie

    def page(self, a, b, number):
        return self.between(a, b)[15 * number : 15 * number + 15]


def test_search_source(spark):
    spark.dataSource.register(portal.search_source("search_ok", Backend(60), "nid int, day date", "nid", "day"))
    df = spark.read.format("search_ok").option("first", "2025-01-01").option("last", "2025-01-31").load()
    assert df.select("nid").distinct().count() == df.count() == 1200
    reader = portal.SearchReader(Backend(60), date(2025, 1, 1), date(2025, 1, 31), ["nid", "day"], "nid", "day")
    assert len(reader.partitions()) > 2 and all(p.rows < portal.CAP for p in reader.partitions())
    with pytest.raises(ValueError, match="more than"):
        portal.SearchReader(Backend(600), date(2025, 1, 1), date(2025, 1, 2), ["nid"], "nid", "day").partitions()
    liar = portal.SearchReader(Backend(10, lie=1), date(2025, 1, 1), date(2025, 1, 31), ["nid"], "nid", "day")
    with pytest.raises(ValueError, match="stated"):
        list(liar.read(liar.partitions()[0]))


class Form(Backend):
    """A search with two selects; it keeps a note of every question."""

    OPTIONS = {"f:depto": {"": "[Todos]", "14": "LA LIBERTAD", "02": "ÁNCASH"}, "f:objeto": {"": "[Todos]", "64": "Obra", "63": "Consultoría de Obra"}}

    def __init__(self, per_day):
        super().__init__(per_day)
        self.asked = []
        for r in self.rows:
            r |= {"region": ("14", "02")[r["nid"] % 2], "object": ("64", "63")[r["nid"] % 3 == 0]}

    def choices(self):
        return self.OPTIONS

    def between(self, a, b, chosen=None):
        codes = {k.replace("f:depto", "region").replace("f:objeto", "object"): v for k, v in (chosen or {}).items()}
        return [r for r in super().between(a, b) if all(r[k] == v for k, v in codes.items())]

    def count(self, a, b, chosen=None):
        self.asked.append((a, b, chosen))
        return len(self.between(a, b, chosen))

    def page(self, a, b, number, chosen=None):
        return [{"nid": r["nid"], "day": r["day"], "note": f"n{r['nid'] % 5}"} for r in self.between(a, b, chosen)][15 * number : 15 * number + 15]


SELECTS = {"region": "f:depto", "object": "f:objeto"}


def test_filters_are_asked_of_the_form(spark):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual

    make = lambda **chosen: portal.FormReader(Form(60), date(2025, 1, 1), date(2025, 1, 31), ["nid", "day", "region", "object"], "nid", "day", SELECTS, chosen)
    reader = make()
    left = [IsNotNull(("region",)), In(("object",), ("Obra", "x")), EqualTo(("note",), "n1"), EqualTo(("region",), "Ancash")]
    asked = [EqualTo(("region",), "la libertad"), GreaterThan(("day",), date(2025, 1, 4)), LessThanOrEqual(("day",), date(2025, 1, 6))]
    assert list(reader.pushFilters([left[0], asked[0], left[1], asked[1], left[2], asked[2], left[3]])) == left
    assert (reader.first, reader.last, reader.codes) == (date(2025, 1, 5), date(2025, 1, 6), {"f:depto": "14"})
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert len(rows) == 60 and {r[2] for r in rows} == {"la libertad"} and {r[1].day for r in rows} == {5, 6}
    assert all(c == {"f:depto": "14"} and a >= date(2025, 1, 5) for a, b, c in reader.backend.asked)
    whole = make()
    assert sum(-(-p.rows // portal.PAGE_ROWS) for p in reader.partitions()) * 15 < sum(-(-p.rows // portal.PAGE_ROWS) for p in whole.partitions())
    with pytest.raises(ValueError, match="LA LIBERTAD, ÁNCASH"):
        list(make().pushFilters([EqualTo(("region",), "Libertad")]))
    assert make(object="consultoria de obra").codes == {"f:objeto": "63"}
    empty = make()
    assert list(empty.pushFilters([GreaterThan(("day",), date(2025, 2, 1))])) == [] and empty.partitions() == []


def test_spark_pushes_filters_into_the_search(spark):
    spark.dataSource.register(portal.search_source("search_form", Form(60), "nid int, day date, region string, object string, note string", "nid", "day", SELECTS))
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format("search_form").option("first", "2025-01-01").option("last", "2025-01-31").option("object", "obra").load()
        wanted = df.filter("region = 'La Libertad' and day >= '2025-01-03' and day < '2025-01-06' and note in ('n1', 'n2')")
        plan = wanted._jdf.queryExecution().executedPlan().toString()
        assert "Filter" in plan and "note" in plan  # what the form cannot ask stays with Spark
        rows = wanted.collect()
        expected = [n for n in range(120, 300) if n % 2 == 0 and n % 3 and n % 5 in (1, 2)]
        assert sorted(r["nid"] for r in rows) == expected and {(r["region"], r["object"]) for r in rows} == {("La Libertad", "obra")}
        assert df.filter("day > '2026-01-01'").count() == 0
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def test_halving_covers_every_day_once():
    found = ranges.halved(date(2025, 1, 1), date(2025, 3, 1), lambda a, b: ((b - a).days + 1) * 10, 50)
    assert found[0][0] == date(2025, 1, 1) and found[-1][1] == date(2025, 3, 1)
    assert all(b[0] == a[1] + timedelta(days=1) for a, b in zip(found, found[1:], strict=False))


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "nid long, block string, v string")
    reports.write_csv(df.coalesce(1), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("part-*")).read_text(encoding="utf-8")
    assert text.splitlines() == ["﻿nid;block;v", "1;a;", "2;b;x"]
    many = spark.range(25).withColumn("block", F.lit("all"))
    row = reports.summary(many, "block", F.col("id").cast("string"), [F.asc("id")]).first()
    assert row["n"] == 25 and row["text"].endswith("- 9\n… y 15 más")
    assert reports.unpivoted(df, ["nid"], ["block", "v"]).count() == 3
    reports.mark_reported(df.filter("nid = 1"), str(tmp_path / "marks"), ["nid"])
    assert [r["nid"] for r in reports.unreported(df, spark.read.parquet(str(tmp_path / "marks")), ["nid"]).collect()] == [2]
