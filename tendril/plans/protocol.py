"""Readers in one pass, as table functions and by version; readings by chains of files; layouts of posts; what OCR is trusted with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import amounts
from ..operators import chain, detail, factor_table, more_readers, personnel, protocol, provenance, readers
from ..sources.tables import table

READERS = [readers.AMOUNT, readers.EXPERIENCE, factor_table.FACTOR_READER, personnel.PERSONNEL, more_readers.OBJECT]


def _joined(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def _soles(amount: Column) -> Column:
    return F.concat(F.lit("S/ "), F.format_number(amount, 2))


def _dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows that large texts will be made of, dealt over the cores before the texts are made."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nid, total, said, text: a document an order with up to five sections, each left out for some orders."""
    orders = _dealt(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("nid"), F.col("o_totalprice").cast(amounts.MONEY).alias("total")), "nid")
    nid, total, n = F.col("nid"), F.col("total"), F.col("nid").cast("string")
    unless = lambda k, section: F.when(nid % k == 0, "").otherwise(section)
    text = F.concat(
        unless(13, _joined("1.3 OBJETO DE LA CONVOCATORIA\n El procedimiento tiene por objeto la ejecución de la obra: “MEJORAMIENTO DEL CAMINO «LA UNIÓN» A ", n, "”, con CUI ", (nid + 2_000_000).cast("string"), "\n\x0c")),
        unless(11, _joined("1.4 CUANTÍA DE LA CONTRATACIÓN\n La cuantía asciende a ", _soles(total), ", con impuestos.\nOBLIGACIONES\nen el presente procedimiento de selección es: FIJA\n\x0c")),
        unless(7, _joined("EXPERIENCIA DEL POSTOR EN LA ESPECIALIDAD\nRequisitos:\nun monto facturado acumulado equivalente a dos (2) veces la cuantía, durante los diez (10) años anteriores\nAcreditación: x\n")),
        unless(5, _joined("B.2 EXPERIENCIA DEL PERSONAL CLAVE\nRequisitos:\n1. RESIDENTE DE OBRA\n  Experiencia    ", (nid % 40 + 1).cast("string"), " meses\nAcreditación: y\n")),
        unless(3, _joined("CUADRO RESUMEN DE LOS FACTORES DE EVALUACIÓN\n A. EXPERIENCIA ADICIONAL       ", (nid % 90 + 1).cast("string"), " puntos\n B. SOSTENIBILIDAD AMBIENTAL   10 puntos\nPUNTAJE TOTAL   ", (nid % 90 + 11).cast("string"), " puntos\n")),
    )
    said = _joined("camino la union ", n, " CUI ", F.when(nid % 17 == 0, "1999999").otherwise((nid + 2_000_000).cast("string")))
    return orders.select("nid", "total", said.alias("said"), text.alias("text"))


def readings_one_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five readers over one crossing of each text."""
    found = protocol.read_all(documents(spark, sf_dir), READERS, given={"stated": F.col("total"), "amount": F.col("total"), "description": F.col("said")})
    r = lambda name: F.col(f"readings.{name}")
    reviews = F.array_join(F.filter(F.array(*(F.when(r(x.name)["review"] == x.missing, F.lit(x.name)) for x in READERS)), lambda x: x.isNotNull()), ",")
    return found.select(
        "nid", r("amount")["amount"].alias("amount"), r("experience")["amount"].alias("experience"), F.try_element_at(r("personnel")["staff"]["months"], F.lit(1)).cast("long").alias("months"), r("factors")["sum"].cast("long").alias("points"),
        r("object")["name"].alias("name"), F.array_join(r("object")["warnings"]["warning"], ",").alias("warnings"), reviews.alias("missing"), F.concat_ws(",", *(r(x.name)["version"] for x in READERS)).alias("versions"),
    )


def factor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of each document's table of factors, by a table function joined LATERAL."""
    rows = protocol.rows_of(spark, factor_table.FACTOR_READER, "factors", "factor_rows")
    found = documents(spark, sf_dir).select("nid", "text").lateralJoin(rows(F.col("text").outer()))
    return found.select("nid", F.col("place").cast("long").alias("place"), "letter", "factor", F.col("points").cast("long").alias("points"))


def readings_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings that a document lacks in the present version; those stored come from order lines: some by an older version."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("nid"))
    name = F.when(F.col("l_linenumber") % 2 == 0, "amount").otherwise("object")
    version = F.when(F.col("l_returnflag") == "R", F.concat(name, F.lit("-0"))).otherwise(F.concat(name, F.lit("-2")))
    done = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("nid"), name.alias("reader"), version.alias("version")).distinct()
    return protocol.due(orders, done, [readers.AMOUNT, more_readers.OBJECT], "nid")


def detail_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the page of a tender tells, in three groups with links: some have no bases, some are not read, some were read by OCR."""
    nid = F.col("nid")
    stated = F.col("total") + F.when(nid % 19 == 0, F.lit("1.00")).otherwise("0.00").cast(amounts.MONEY)
    read = protocol.read_all(documents(spark, sf_dir), READERS, given={"stated": stated, "amount": F.col("total"), "description": F.col("said")})
    done = nid % 23 > 0
    records = {r.name: F.when(done, F.col(f"readings.{r.name}")) for r in READERS}
    read = read.withColumns({"document": F.when(nid % 29 > 0, nid + 5), "file": _joined("Bases N° ", nid.cast("string"), F.when(nid % 2 == 0, ".pdf").otherwise(".DOCX"))})
    source = F.when(nid % 4 == 0, "ocr").otherwise("text")
    differ = {"amount": F.when(done & (nid % 31 == 0), F.array(F.lit("amount")))}
    found = detail.notes(read, "nid", "document", "file", records, source, differ)
    return found.select("nid", "group", F.col("place").cast("long").alias("place"), "text", "page", "link")


# --- chains -------------------------------------------------------------------------------------------------------

_PLENTY = "palabras de relleno para una página que no es imagen " * 12  # no image: over 400 characters
_LITTLE = "texto de una página con imagen, que no es un escaneo porque tiene más de ochenta caracteres en ella. "


def _holds(amount: Column, around: str = _LITTLE) -> Column:
    return _joined(around, "1.4 CUANTÍA DE LA CONTRATACIÓN\nLa cuantía asciende a ", _soles(amount), "\nOBLIGACIONES\n")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of documents of twelve kinds by nid: where the section is, what was copied, what failed."""
    orders = _dealt(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("nid"), F.col("o_totalprice").cast(amounts.MONEY).alias("stated")), "nid")
    k, total = F.col("nid") % 12, F.col("stated")
    near = _holds(total + F.lit("1.00").cast(amounts.MONEY))
    none = F.lit(None).cast("string")

    def row(n: int, name: str, kind: str, text, when: Column) -> Column:
        said = text if isinstance(text, Column) else F.lit(text)
        return F.when(when, F.struct(F.lit(n).alias("file"), F.lit(name).alias("name"), F.lit(kind).alias("kind"), said.alias("text"), F.when(said.isNull(), "roto").alias("error")))

    annexes = range(1, 5)
    each = F.array(
        row(1, "anexo.pdf", "text", F.when(k == 0, _holds(total)).otherwise(F.lit(_PLENTY)), k <= 1), row(2, "BASES.pdf", "text", _holds(total), k <= 1),
        *(row(1, "BASES.pdf", "text", "sello", (k == x)) for x in (2, 3, 4, 5, 6)),
        row(1, "BASES.pdf", "model", F.when(k == 4, F.lit(_LITTLE)).otherwise(_holds(total)), k.isin(2, 3, 4)),
        row(1, "BASES.pdf", "ocr", F.when(k == 3, near).when(k == 6, none).otherwise(_holds(total)), k.between(2, 6)),
        row(1, "BASES.pdf", "text", none, k == 7),
        row(1, "BASES.pdf", "text", _PLENTY, k == 9),
        *(row(n, f"anexo {n}.pdf", "text", "", k >= 10) for n in annexes),
        *(row(n, f"anexo {n}.pdf", "model", _holds(total) if n == 4 else _LITTLE, k == 10) for n in annexes),
        *(row(n, f"anexo {n}.pdf", "ocr", _holds(total) if n == 3 else _LITTLE, k == 11) for n in annexes),
    )
    return orders.select("nid", "stated", F.explode(F.filter(each, lambda f: f.isNotNull())).alias("f")).select("nid", "stated", "f.*")


def _chained(spark: SparkSession, sf_dir: str, ocr: bool) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("nid"))
    found = chain.read_documents(orders, files(spark, sf_dir), readers.AMOUNT, "nid", given=["stated"], ocr=ocr, ocr_files=None)
    return found.select("nid", F.col("amount.amount").alias("amount"), "name", "source", F.array_join("second", ",").alias("differ"), "review", "deferred", "looked")


def chain_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chained(spark, sf_dir, True)


def chain_without_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chained(spark, sf_dir, False)


# --- layouts of posts, OCR ----------------------------------------------------------------------------------------

_TITLE, _END = "\x0cB.2 EXPERIENCIA DEL PERSONAL CLAVE\nRequisitos:\n", "\nAcreditación: con contratos de 99 meses"


def layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey, text: tables of two posts, laid out in ten ways by the key."""
    parts = _dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    n, m = F.col("p_size").cast("string"), (F.col("p_size") * 2).cast("string")
    wide = "como residente o supervisor en obras de la especialidad"
    ways = [
        # the heads are centred over their columns; the posts wrap
        ("     CARGO                         EXPERIENCIA\nRESIDENTE DE       ", n, f" meses {wide}\nOBRA               y subespecialidad, computados desde la colegiatura\nESPECIALISTA EN    ", m, f" meses {wide}\nSUELOS             y subespecialidad, computados desde la colegiatura"),
        # a short column of professions between the posts and the times
        ("CARGO              PROFESIÓN        EXPERIENCIA\nRESIDENTE DE       Ingeniero        ", n, f" meses {wide}\nOBRA               Civil            y subespecialidad\nESPECIALISTA EN    Ingeniero        ", m, f" meses {wide}\nSUELOS             Geólogo          y subespecialidad"),
        # words broken in two, on a line and over two
        ("CARGO              EXPERIENCIA\nResiden te de      ", n, f" meses {wide}\nObra               y subespecialidad\nEspecialis         ", m, f" meses {wide}\nta en Suelos       y subespecialidad"),
        # a signature stamp in the posts' column
        ("CARGO              EXPERIENCIA\nRESIDENTE DE       ", n, f" meses {wide}\nFirmado digitalmente por PEREZ\nMotivo: visto\nFecha: 01/02\nOBRA               y subespecialidad\nESPECIALISTA EN    ", m, f" meses {wide}\nSUELOS             y subespecialidad"),
        # a note ends the table
        ("CARGO              EXPERIENCIA\nRESIDENTE DE       ", n, f" meses {wide}\nOBRA               y subespecialidad\nESPECIALISTA EN    ", m, f" meses {wide}\nSUELOS             y subespecialidad\nImportante\nLas obras similares son las de la lista"),
        # the unit of a time on the next line
        ("CARGO              EXPERIENCIA\nRESIDENTE DE       experiencia mínima en obras de la especialidad (", n, ")\nOBRA               meses y subespecialidad\nESPECIALISTA EN    experiencia mínima en obras de la especialidad (", m, ")\nSUELOS             meses y subespecialidad"),
        # the heads come again on the next page, with the tender's lines
        ("CARGO              EXPERIENCIA\nRESIDENTE DE       ", n, f" meses {wide}\nOBRA               y subespecialidad\n\x0cMUNICIPALIDAD DE X\nLICITACIÓN PÚBLICA 3\nCARGO              EXPERIENCIA\nESPECIALISTA EN    ", m, f" meses {wide}\nSUELOS             y subespecialidad"),
        # one row a line, a post that no word of posts opens, under its head
        ("CARGO   EXPERIENCIA\nResidente de Obra   ", n, " meses en obras\nSeguridad y Medio Ambiente   ", m, " meses en obras"),
        # what is asked after a comma; a choice in a post's own line
        ("➢ Residente de Obra, debe acreditar ", n, " meses, en: obras\n➢ Especialista en Salud y/o SSOMA: mínimo ", m, " meses"),
        # words of a description within the posts' column: nobody can tell
        ("CARGO                    EXPERIENCIA\nIngeniero Residente      ", n, " meses como residente y/o supervisor y/o inspector\ny/o jefe de Obra         de obras\nEspecialista en y/o      ", m, " meses en obras de la especialidad\nSuelos                   y subespecialidad"),
    ]
    made = F.when(F.lit(False), "")
    for k, parts_of in enumerate(ways):
        made = made.when(F.col("p_partkey") % len(ways) == k, _joined(_TITLE, *parts_of, _END))
    return parts.select("p_partkey", made.alias("text"))


def reader_personnel_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("personnel")
    staff = F.array_join(F.transform(r["staff"], lambda x: F.concat_ws(":", F.coalesce(x["post"], F.lit("?")), x["months"])), ";")
    return personnel.read_personnel(layouts(spark, sf_dir)).select("p_partkey", staff.alias("staff"), r["review"].alias("review"))


def ocr_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of posts and factors, by source: what OCR says wrong is not the document's fault."""
    parts = _dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    key, n = F.col("p_partkey"), F.col("p_size").cast("string")
    post = F.when(key % 4 == 0, "Residente de Obra").when(key % 4 == 1, "Residente de Obra Especialats SOOMA").otherwise("Especialista en Geología y Suelos")
    months = F.when(key % 4 == 3, _joined("doce (", n, ") meses")).otherwise(_joined(n, " meses"))
    posts = _joined(_TITLE, "a) ", post, "\nAcredita ", months, " en obras similares.", _END)
    figures = _joined("EVALUACIÓN TÉCNICA\nA. EXPERIENCIA DEL POSTOR\nEvaluación: hasta\n ", F.when(key % 3 == 0, "70").otherwise("60"), " puntos\nCUADRO RESUMEN DE LOS FACTORES DE EVALUACIÓN\nA. EXPERIENCIA DEL POSTOR  60 puntos\nB. CALIDAD   ", F.when(key % 5 == 0, "30").otherwise("40"), " puntos\nPUNTAJE TOTAL  100 puntos")
    source = F.when(key % 2 == 0, "ocr").when(key % 7 == 0, "model").otherwise("text")
    read = personnel.read_personnel(parts.select("p_partkey", source.alias("source"), posts.alias("text"), figures.alias("figures")))
    read = factor_table.read_factors(read, "figures")
    trusted = read.select("p_partkey", "source", provenance.trusted_personnel(F.col("personnel"), F.col("source")).alias("p"), provenance.trusted_factors(F.col("factors"), F.col("source")).alias("f"))
    names = lambda c: F.array_join(c["warnings"]["warning"], ",")
    return trusted.select("p_partkey", "source", F.get("p.staff", F.lit(0))["post"].alias("post"), names(F.col("p")).alias("post_warnings"), F.col("p.review").alias("post_review"), names(F.col("f")).alias("factor_warnings"), F.col("f.review").alias("factor_review"))


QUERIES = {f.__name__: f for f in (readings_one_pass, factor_rows, readings_due, detail_notes, chain_of_files, chain_without_ocr, reader_personnel_layouts, ocr_trust)}

_TOTAL = "CAST(o_totalprice AS DECIMAL(15,2))"


def _chain_sql(ocr: bool) -> str:
    hit = "k IN (0, 1, 2, 3, 4, 5, 10, 11)" if ocr else "k IN (0, 1, 2, 3, 10)"
    looked = {0: 1, 1: 2, 2: 1, 3: 1, 4: 2, 5: 1, 6: 0, 7: 0, 8: 0, 9: 1, 10: 4, 11: 3} | ({} if ocr else {4: 1, 5: 0, 11: 0})
    name = "CASE WHEN k = 0 THEN 'anexo.pdf' WHEN k = 10 THEN 'anexo 4.pdf' WHEN k = 11 THEN 'anexo 1.pdf' WHEN k IN (1, 2, 3, 5, 6) OR k = 4 AND " + ("true" if ocr else "false") + " THEN 'BASES.pdf' END"
    source = "CASE WHEN k <= 1 THEN 'text' WHEN k IN (2, 3, 10) THEN 'model' WHEN k IN (4, 5, 11) THEN 'ocr' END" if ocr else "CASE WHEN k <= 1 THEN 'text' WHEN k IN (2, 3, 10) THEN 'model' END"
    # the eleventh kind's third copy by OCR holds the section; without OCR its files stay unread scans
    name = name.replace("'anexo 1.pdf'", "'anexo 3.pdf'" if ocr else "'anexo 1.pdf'")
    differ = "CASE k WHEN 2 THEN '' WHEN 3 THEN 'amount' END" if ocr else "CAST(NULL AS VARCHAR)"
    scans = "k IN (6)" if ocr else "k IN (5, 6, 11)"
    return f"""
        SELECT o_orderkey AS nid, CASE WHEN {hit} THEN {_TOTAL} END AS amount, {name} AS name, {source} AS source, {differ} AS differ,
          CASE WHEN {scans} THEN 'documento escaneado' WHEN k = 7 THEN 'ilegible: BASES.pdf: roto' WHEN k = 8 THEN 'sin PDF ni DOCX' WHEN NOT ({hit}) THEN 'sin sección 1.4' END AS review,
          {"false" if ocr else "k IN (4, 5, 6, 11)"} AS deferred, CAST(CASE k {" ".join(f"WHEN {k} THEN {n}" for k, n in looked.items())} END AS BIGINT) AS looked
        FROM (SELECT *, o_orderkey % 12 AS k FROM orders)"""


ORACLE_SQL = {
    "readings_one_pass": f"""
        SELECT nid, CASE WHEN nid % 11 > 0 THEN total END AS amount, CASE WHEN nid % 7 > 0 THEN CAST(2 * total AS DECIMAL(15,2)) END AS experience, CASE WHEN nid % 5 > 0 THEN nid % 40 + 1 END AS months, CASE WHEN nid % 3 > 0 THEN nid % 90 + 11 END AS points,
          CASE WHEN nid % 13 > 0 THEN 'MEJORAMIENTO DEL CAMINO «LA UNIÓN» A ' || nid END AS name, CASE WHEN nid % 13 > 0 AND nid % 17 = 0 THEN 'cui_distinto_seace' ELSE '' END AS warnings,
          concat_ws(',', CASE WHEN nid % 11 = 0 THEN 'amount' END, CASE WHEN nid % 7 = 0 THEN 'experience' END, CASE WHEN nid % 3 = 0 THEN 'factors' END, CASE WHEN nid % 5 = 0 THEN 'personnel' END, CASE WHEN nid % 13 = 0 THEN 'object' END) AS missing,
          'amount-2,experience-2,factors-2,personnel-2,object-2' AS versions
        FROM (SELECT o_orderkey AS nid, {_TOTAL} AS total FROM orders)""",
    "factor_rows": """
        WITH o AS (SELECT o_orderkey AS nid FROM orders WHERE o_orderkey % 3 > 0)
        SELECT nid, CAST(1 AS BIGINT) AS place, 'A' AS letter, 'EXPERIENCIA ADICIONAL' AS factor, nid % 90 + 1 AS points FROM o UNION ALL SELECT nid, 2, 'B', 'SOSTENIBILIDAD AMBIENTAL', 10 FROM o""",
    "readings_due": """
        SELECT o_orderkey AS nid, reader, reader || '-2' AS version FROM orders, (VALUES ('amount', 0), ('object', 1)) r(reader, odd)
        WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber % 2 = odd AND l_returnflag <> 'R')""",
    "detail_notes": f"""
        WITH o AS (SELECT o_orderkey AS nid, {_TOTAL} AS total FROM orders),
        p AS (SELECT *, CASE WHEN nid % 13 > 0 THEN 1 ELSE 0 END AS obj, CASE WHEN nid % 11 > 0 THEN 1 ELSE 0 END AS amo, nid % 29 > 0 AND nid % 23 > 0 AS told, CASE WHEN nid % 4 = 0 THEN 'mirar' ELSE 'consultar' END AS grp FROM o),
        n AS (
          SELECT nid, 'revisar' AS "group", 0 AS step, 'Bases todavía no descargadas.' AS text, NULL AS page FROM p WHERE nid % 29 = 0
          UNION ALL SELECT nid, 'revisar', 0, 'Bases descargadas, todavía sin leer.', NULL FROM p WHERE nid % 29 > 0 AND nid % 23 = 0
          UNION ALL SELECT nid, 'revisar', 1, 'Revisar a mano: sin sección 1.4', NULL FROM p WHERE told AND amo = 0
          UNION ALL SELECT nid, grp, 2, 'La cuantía de las bases (S/ ' || format('{{:,.2f}}', CAST(total AS DOUBLE)) || ') no es la de la ficha (S/ ' || format('{{:,.2f}}', CAST(total + 1 AS DOUBLE)) || ').', 1 + obj FROM p WHERE told AND amo = 1 AND nid % 19 = 0
          UNION ALL SELECT nid, 'mirar', 3, 'Las dos lecturas del escaneo no coinciden en amount. Mirar la página.', CASE WHEN amo = 1 THEN 1 + obj END FROM p WHERE told AND nid % 31 = 0
          UNION ALL SELECT nid, grp, 4, 'El CUI de las bases (' || (nid + 2000000) || ') no es el que nombra la descripción (1999999): puede ser otra obra.', 1 FROM p WHERE told AND obj = 1 AND nid % 17 = 0
          UNION ALL SELECT nid, 'revisar', 5, 'Experiencia del postor: sin requisito de experiencia del postor', NULL FROM p WHERE told AND nid % 7 = 0
          UNION ALL SELECT nid, 'revisar', 6, 'Personal clave: sin requisito de personal clave', NULL FROM p WHERE told AND nid % 5 = 0
          UNION ALL SELECT nid, 'revisar', 7, 'Factores de evaluación: sin cuadro de factores', NULL FROM p WHERE told AND nid % 3 = 0
          UNION ALL SELECT nid, 'consultar', 8, 'El puntaje total del cuadro resumen es ' || (nid % 90 + 11) || ', no 100.', 1 + obj + amo FROM p WHERE told AND nid % 3 > 0 AND nid % 90 <> 89),
        l AS (SELECT nid, "group", row_number() OVER (PARTITION BY nid ORDER BY step) AS place, text, CASE WHEN nid % 2 = 0 THEN page END AS page, page IS NOT NULL AS paged FROM n)
        SELECT nid, "group", place, text, CAST(page AS BIGINT) AS page, CASE WHEN nid % 29 > 0 AND (paged OR nid % 2 = 1) THEN '/obras/' || nid || '/bases/' || (nid + 5) || '/Bases%20N%C2%B0%20' || nid || CASE WHEN nid % 2 = 0 THEN '.pdf#page=' || page ELSE '.DOCX' END END AS link FROM l""",
    "chain_of_files": _chain_sql(True),
    "chain_without_ocr": _chain_sql(False),
    "reader_personnel_layouts": """
        WITH p AS (SELECT p_partkey, p_partkey % 10 AS k, p_size AS n, 2 * p_size AS m FROM part)
        SELECT p_partkey, CASE WHEN k = 2 THEN 'Residente de Obra' WHEN k IN (7, 8) THEN 'Residente de Obra' WHEN k = 9 THEN '?' ELSE 'RESIDENTE DE OBRA' END || ':' || n || ';' ||
          CASE k WHEN 2 THEN 'Especialista en Suelos' WHEN 7 THEN 'Seguridad y Medio Ambiente' WHEN 8 THEN 'Especialista en Salud y/o SSOMA' WHEN 9 THEN '?' ELSE 'ESPECIALISTA EN SUELOS' END || ':' || m AS staff,
          CASE WHEN k = 9 THEN 'cargos ilegibles' END AS review FROM p""",
    "ocr_trust": """
        WITH p AS (SELECT p_partkey AS p, p_size AS n, CASE WHEN p_partkey % 2 = 0 THEN 'ocr' WHEN p_partkey % 7 = 0 THEN 'model' ELSE 'text' END AS source FROM part),
        q AS (SELECT *, source = 'ocr' AND (p % 4 = 1 OR p % 4 = 3 AND n <> 12) AS bad, p % 4 = 3 AND n <> 12 AS differ, p % 5 = 0 AND NOT p % 3 = 0 AS short, p % 3 = 0 AND p % 5 > 0 AS above FROM p)
        SELECT p AS p_partkey, source, CASE WHEN bad THEN NULL WHEN p % 4 = 0 THEN 'Residente de Obra' WHEN p % 4 = 1 THEN 'Residente de Obra Especialats SOOMA' ELSE 'Especialista en Geología y Suelos' END AS post,
          CASE WHEN differ AND NOT bad THEN 'tiempo_distinto_letras' ELSE '' END AS post_warnings, CASE WHEN bad THEN 'cargos ilegibles' END AS post_review,
          CASE WHEN short AND source <> 'ocr' THEN 'suma_distinta_total' WHEN p % 3 = 0 AND source <> 'ocr' THEN 'puntaje_distinto' ELSE '' END AS factor_warnings, CASE WHEN short AND source = 'ocr' THEN 'cuadro de factores ilegible' END AS factor_review
        FROM q""",
}
