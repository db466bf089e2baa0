"""Facets beside a listing, faults of filled records, running lines of pages, and sentences from records not told yet."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import amounts, dates, text
from ..operators import facets, filters, selection, sentences, validation
from ..sources.tables import dealt, table
from .report import now


def listing_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search finds and what it may find, by region, priority and year, and in all."""
    people = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    readings = table(spark, sf_dir, "events").filter("event_type = 'purchase'").groupBy("user_id").agg(F.max("value").alias("experience"))
    base = table(spark, sf_dir, "orders").join(people.select("c_custkey", "r_name", "n_name"), F.col("o_custkey") == F.col("c_custkey")).join(readings, F.col("o_custkey") == F.col("user_id"), "left")
    base = base.select((F.col("o_orderstatus") == "O").alias("is_open"), F.col("o_totalprice").cast(amounts.MONEY).alias("amount"), F.col("experience").cast(amounts.MONEY).alias("experience"), "r_name", "n_name", "o_orderpriority", "o_orderdate")
    asked = filters.Filters(least="50000", most="250000", most_experience="90")
    by = {"place": F.array("r_name", F.concat(F.lit("N-"), F.col("n_name")), F.col("r_name")), "priority": F.col("o_orderpriority"), "year": F.year("o_orderdate")}
    return facets.listing_facets(base, asked, now(), by)


# --- filled records -----------------------------------------------------------------------------------------------

_POST = {"cargo": "Residente de obra", "cantidad": 1, "profesiones": ["Ingeniero civil", "Arquitecto"], "grado": "bachiller", "colegiado": True, "meses": 24, "desde_colegiatura": True, "roles": ["Residente"], "areas": [], "ambito": "obras en general", "ventana_anios": 20, "cita": "x", "pagina": "3"}
_FACTOR = {"letra": "A", "nombre": "Personal", "parte": "A", "puntos_max": 70, "cita": "c", "pagina": "1", "tipo": "personal_adicional", "cargos": ["Residente de obra"], "anios_extra": 1, "escala": [{"pct_minimo": 50, "puntos": 70}, {"pct_minimo": 25.5, "puntos": 30}]}
_LEVEL = {"letra": "D", "nombre": "Integridad", "parte": "D", "puntos_max": 30, "cita": "c", "pagina": "2", "tipo": "certificacion_empresa", "certificado": "ISO 37001", "alcance_pedido": "ninguno", "escala": [{"nivel": "acredita", "puntos": 30}]}
_BLOCK = {"monto": 436482.01, "veces_cuantia": 1, "especialidad": "Viales", "subespecialidades": ["Puentes"], "tipologias": [], "ventana_anios": 20, "cuenta_desde": "acta de recepción", "cita": "x", "pagina": "9"}

#: (field, number, row as filled, its fault); the key of a part says which it has.
CASES: list[tuple[str, int | None, dict | str, str | None]] = [
    ("personal_clave", 1, _POST, None),
    ("personal_clave", 1, _POST | {"meses": "24 meses"}, 'personal_clave 1: `meses` must be a whole number above 0, got "24 meses"'),
    ("personal_clave", 2, _POST | {"ambito": "general"}, 'personal_clave 2: `ambito` must be one of subespecialidad | obras en general, got "general"'),
    ("personal_clave", 1, _POST | {"profesiones": []}, "personal_clave 1: `profesiones` must be a list of texts, not empty, got []"),
    ("personal_clave", 1, _POST | {"areas": ["SSOMA"]}, None),
    ("personal_clave", 1, _POST | {"areas": [" "]}, 'personal_clave 1: `areas` must be a list of texts, got [" "]'),
    ("personal_clave", 3, _POST | {"desde_colegiatura": 1}, "personal_clave 3: `desde_colegiatura` must be true or false, got 1"),
    ("personal_clave", 1, {k: v for k, v in _POST.items() if k != "cita"} | {"zeta": 1}, "personal_clave 1: unknown columns [zeta], missing columns [cita]"),
    ("experiencia_requerida", None, _BLOCK, None),
    ("experiencia_requerida", None, _BLOCK | {"monto": "S/ 436,482.01"}, 'experiencia_requerida: `monto` must be a number above 0, got "S/ 436,482.01"'),
    ("experiencia_requerida", None, _BLOCK | {"cita": ""}, 'experiencia_requerida: `cita` must be text, got ""'),
    ("experiencia_requerida", None, _BLOCK | {"ventana_anios": 2.5}, "experiencia_requerida: `ventana_anios` must be a whole number above 0, got 2.5"),
    ("factores", 1, _FACTOR, None),
    ("factores", 2, _LEVEL, None),
    ("factores", 1, _FACTOR | {"tipo": "certificado"}, 'factores 1: `tipo` must be one of personal_adicional | experiencia_adicional | certificacion_empresa | capacitacion_personal | herramienta | juicio_comite, got "certificado"'),
    ("factores", 2, _LEVEL | {"escala": [{"nivel": "acredita", "puntos": 30}, {"nivel": "", "puntos": 1}]}, 'factores 2: escala 2: `nivel` must be text, got ""'),
    ("factores", 2, {k: v for k, v in _LEVEL.items() if k != "certificado"}, "factores 2: unknown columns [], missing columns [certificado]"),
    ("factores", 1, _FACTOR | {"escala": []}, "factores 1: `escala` must be a list of steps, got []"),
    ("factores", 1, _FACTOR | {"escala": [{"pct_minimo": 50}]}, "factores 1: escala 1: unknown columns [], missing columns [puntos]"),
    ("cuantia", None, {"monto": None, "cita": "x", "pagina": "1"}, "cuantia: `monto` must be a number above 0, got null"),
    ("cuantia", None, "no json", "cuantia: no table"),
    ("garantias", None, {}, "garantias: unknown field"),
]


def record_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = [(k, f, n, r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)) for k, (f, n, r, _) in enumerate(CASES)]
    filled = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(n).cast("int").alias("number"), F.lit(r).alias("json")) for _, f, n, r in written))
    rows = dealt(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select("p_partkey", F.get(filled, (F.col("p_partkey") % len(CASES)).cast("int")).alias("r")).select("p_partkey", "r.*")
    return validation.faults(rows, ["p_partkey"], "field", "number", "json", validation.SCHEMAS).select("p_partkey", "field", F.col("number").cast("long").alias("number"), "fault")


# --- pages --------------------------------------------------------------------------------------------------------

_DIGITS, _LETTERS = "0123456789", "ghijklmnop"


def running_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one to six pages with a header, a page number at the top and at the foot, and on every other page a header beside the text."""
    key, n = F.col("c_custkey"), (F.col("c_custkey") % 6 + 1).cast("int")

    def page(i: Column) -> Column:
        body = lambda k: F.translate(F.md5(F.concat_ws("-", key, i, F.lit(k))), _DIGITS, _LETTERS)
        beside = F.when(i % 2 == 0, "      LICITACIÓN PÚBLICA").otherwise("")
        return F.concat(F.lit("MUNICIPALIDAD de "), F.col("c_mktsegment"), F.lit("\n  Página "), i.cast("string"), F.lit(" de "), n.cast("string"), F.lit("\n\n"), body(1), beside, F.lit("\n"), body(2), F.lit("\n   "), i.cast("string"), F.lit("\n"))

    made = F.array_join(F.transform(F.sequence(F.lit(1), n), page), text.FEED)
    return dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey").select("c_custkey", text.without_running_lines(made).alias("clean"))


# --- sentences ----------------------------------------------------------------------------------------------------


def untold_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual readings that no report has told, in sentences: parts stand for readings, suppliers for tenders."""
    key = F.col("p_partkey")
    kinds = F.array(*map(F.lit, ("personal_adicional", "experiencia_adicional", "certificacion_empresa", "capacitacion_personal", "herramienta", "juicio_comite")))
    texts = lambda *values: F.array(*(F.lit(v) if isinstance(v, str) else v for v in values))
    since = F.when(key % 2 == 0, sentences.RECEPTION).otherwise("conformidad o comprobante de pago")
    block = F.struct(
        F.col("p_retailprice").cast(amounts.MONEY).alias("monto"), F.when(key % 3 == 0, F.lit(1.0)).otherwise(F.lit(1.5)).alias("veces_cuantia"), F.col("p_brand").alias("especialidad"), texts("Puentes", F.col("p_type")).alias("subespecialidades"),
        F.when(key % 4 == 0, texts("A", "B")).otherwise(F.array().cast("array<string>")).alias("tipologias"), (key % 20 + 1).alias("ventana_anios"), since.alias("cuenta_desde"),
    )
    post = F.struct(
        F.lit("Residente de obra").alias("cargo"), F.lit(1).alias("cantidad"), texts("Ingeniero", "Arquitecto").alias("profesiones"), F.lit("bachiller").alias("grado"), (key % 2 == 0).alias("colegiado"), F.col("p_size").alias("meses"), (key % 3 == 0).alias("desde_colegiatura"),
        texts("Jefe", "Residente").alias("roles"), F.when(key % 5 == 0, texts("SSOMA")).otherwise(F.array().cast("array<string>")).alias("areas"), F.when(key % 2 == 0, "subespecialidad").otherwise("obras en general").alias("ambito"), F.lit(20).alias("ventana_anios"),
    )
    step = F.struct(F.lit(50.5).alias("pct_minimo"), F.col("p_retailprice").cast(amounts.MONEY).alias("monto_minimo"), (key % 2 == 0).alias("estricto"), F.lit("acredita").alias("nivel"), F.col("p_size").alias("puntos"))
    factor = F.struct(
        F.lit("K").alias("letra"), F.lit("Nombre").alias("nombre"), F.when(key % 2 == 0, "k.1").otherwise("K").alias("parte"), F.lit(100).alias("puntos_max"), F.get(kinds, (key % 6).cast("int")).alias("tipo"), texts("Residente", "Jefe").alias("cargos"), (key % 2 + 1).alias("anios_extra"),
        F.array(step, step).alias("escala"), F.lit(10).alias("ventana_anios"), since.alias("cuenta_desde"), F.lit("ISO").alias("certificado"), F.when(key % 4 == 2, "ninguno").otherwise("obras").alias("alcance_pedido"), F.lit("Jefe").alias("cargo"), F.lit("BIM").alias("tema"), F.lit("Software").alias("herramienta"), F.lit("el plan").alias("que_se_juzga"),
    )
    other = F.struct((key % 2 == 0).alias("consulta"), F.lit("No coincide").alias("descripcion"), F.lit("la tabla").alias("lectura_usada"), F.when(key % 3 == 0, "").otherwise("factores").alias("campo"), F.when(key % 3 == 1, "K").otherwise("").alias("fila"), F.lit("puntos_max").alias("columna"), F.lit("25").alias("valor"))
    readings = table(spark, sf_dir, "part").select(
        key.alias("reading"), (key + 7).alias("document"), F.when(key % 7 == 0, "failed").otherwise("done").alias("state"), F.when(key % 5 == 0, F.lit("2000-01-01")).alias("reported"), F.when(key % 3 == 2, "factors-2").otherwise("manual").alias("version"),
        block.alias("block"), F.array(post).alias("posts"), F.array(factor).alias("factors"), F.array(other).alias("others"),
    )
    documents = table(spark, sf_dir, "part").select((key + 7).alias("document"), (key % 40).alias("tender"))
    tenders = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tender"), F.col("s_name").alias("title"))
    found = sentences.untold(readings, documents, tenders, "document", "tender")
    fields = [
        ("experiencia_requerida", F.array(sentences.experience(F.col("block")))), ("personal_clave", F.transform("posts", sentences.post)), ("factores", F.transform("factors", sentences.factor)), ("incongruencias", F.transform("others", sentences.incongruence)),
    ]
    told = sentences.lines(found.withColumn("questions", sentences.questions(F.col("others")).cast("long")), ["reading", "tender", "title", "questions"], fields)
    return told.withColumn("place", F.col("place").cast("long"))


# --- what is to be done -------------------------------------------------------------------------------------------


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for documents, customers for tenders."""
    key = F.col("o_orderkey")
    kind = F.when(key % 5 == 0, "Acta").when(key % 5 == 1, "BASES Integradas").otherwise("Bases Administrativas")
    path = F.concat(F.lit("/d/"), key.cast("string"), F.when(key % 3 == 0, ".ZIP").when(key % 3 == 1, ".pdf").otherwise(".docx"))
    return table(spark, sf_dir, "orders").select(
        key.alias("doc"), F.col("o_custkey").alias("tender"), kind.alias("type"), path.alias("path"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("done").alias("state"), F.when(key % 11 > 0, F.col("o_orderdate")).alias("published"), F.when(key % 2 == 0, "done").alias("unpacked")
    )


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct lines of archives stand for their files."""
    lines = table(spark, sf_dir, "lineitem").filter("l_orderkey % 3 = 0").select("l_orderkey", "l_linenumber", "l_returnflag").distinct()
    return lines.select(F.col("l_orderkey").alias("doc"), F.concat_ws("-", "l_linenumber", "l_returnflag").alias("content"), F.concat_ws("-", F.lit("f"), "l_linenumber", "l_returnflag").alias("path"), F.when(F.col("l_returnflag") == "R", "broken").alias("error"))


def bases_to_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    version = F.when(F.col("l_linenumber") == 1, "amount-2").when(F.col("l_linenumber") == 2, "amount-1").otherwise("object-2")
    readings = lines.select(F.col("l_orderkey").alias("doc"), version.alias("version"), "l_linenumber", "l_shipdate", F.col("l_extendedprice").cast(amounts.MONEY).alias("amount")).filter("l_linenumber > 1 or doc % 4 = 0")
    readings = readings.withColumn("at", F.struct("l_shipdate", "amount")).select("doc", "version", "at", "amount")
    found = selection.bases_to_read(_documents(spark, sf_dir), _contents(spark, sf_dir), readings, "amount-2")
    return found.select("doc", "tender", "path", "newest", F.array_join("contents", ",").alias("contents"), "amount")


def newest_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.newest_bases(_documents(spark, sf_dir), _contents(spark, sf_dir)).select("tender", "doc", F.array_join("contents", ",").alias("contents"))


def queue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives to unpack and documents to fetch, each in the order of their numbers."""
    todo = F.when(F.col("state") == "pending", "fetch").when(F.col("path").ilike("%.zip") & F.col("unpacked").isNull(), "unpack")
    return selection.queue(_documents(spark, sf_dir), todo)


def pending_urgent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of customers in watched regions, or of none, the most urgent first."""
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    people = table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.when(F.col("c_custkey") % 10 > 0, F.array("r_name")).alias("regions"))
    limit = F.when(F.col("o_orderkey") % 13 > 0, F.col("o_orderdate"))
    tenders = table(spark, sf_dir, "orders").join(people, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "regions", limit.alias("limit"), F.when(F.col("o_orderstatus") == "F", F.lit(1)).alias("reported"))
    found = selection.pending(tenders, ["asia", "Europe"], dates.days_until(F.col("limit"), now()), "o_orderkey")
    return found.select("o_orderkey", F.col("place").cast("long").alias("place"))


QUERIES = {f.__name__: f for f in (listing_facets, record_faults, running_lines, untold_sentences, bases_to_read, newest_bases, queue_rows, pending_urgent)}

_DOCUMENTS = """d AS (SELECT o_orderkey AS doc, o_custkey AS tender, CASE o_orderkey % 5 WHEN 0 THEN 'Acta' WHEN 1 THEN 'BASES Integradas' ELSE 'Bases Administrativas' END AS type, '/d/' || o_orderkey || CASE o_orderkey % 3 WHEN 0 THEN '.ZIP' WHEN 1 THEN '.pdf' ELSE '.docx' END AS path,
          o_orderstatus <> 'P' AS done, CASE WHEN o_orderkey % 11 > 0 THEN o_orderdate END AS published, o_orderkey % 2 = 0 AS unpacked FROM orders),
        b AS (SELECT *, row_number() OVER (PARTITION BY tender ORDER BY type ILIKE '%integrad%' DESC, published DESC NULLS LAST, doc DESC) = 1 AS newest FROM d WHERE done AND type ILIKE 'bases%'),
        c AS (SELECT l_orderkey AS doc, string_agg('f-' || l_linenumber || '-' || l_returnflag, ',' ORDER BY l_linenumber || '-' || l_returnflag) AS contents FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_orderkey % 3 = 0 AND l_returnflag <> 'R') GROUP BY 1)"""

_QUOTE = lambda s: "NULL" if s is None else "'" + s.replace("'", "''") + "'"
_SINCE = "CASE WHEN k % 2 = 0 THEN 'el acta de recepción' ELSE 'la conformidad o el pago' END"
_MONEY = "'S/ ' || format('{:,.2f}', price)"
ORACLE_SQL = {
    "listing_facets": """
        WITH r AS (SELECT user_id, max(value) AS experience FROM events WHERE event_type = 'purchase' GROUP BY 1),
        b AS (SELECT CASE WHEN o_orderstatus <> 'O' OR NOT CAST(o_totalprice AS DECIMAL(15,2)) BETWEEN 50000 AND 250000 OR coalesce(CAST(experience AS DECIMAL(15,2)) > 90, false) THEN 'no' WHEN experience IS NULL THEN 'sin_leer' ELSE 'si' END AS verdict, r_name, n_name, o_orderpriority, o_orderdate
              FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey LEFT JOIN r ON user_id = o_custkey),
        f AS (SELECT verdict, NULL AS facet, NULL AS value FROM b UNION ALL SELECT verdict, 'place', r_name FROM b UNION ALL SELECT verdict, 'place', 'N-' || n_name FROM b UNION ALL SELECT verdict, 'priority', o_orderpriority FROM b UNION ALL SELECT verdict, 'year', CAST(year(o_orderdate) AS VARCHAR) FROM b)
        SELECT facet, value, count(*) FILTER (WHERE verdict = 'si') AS found, count(*) FILTER (WHERE verdict = 'sin_leer') AS unread, count(*) AS every FROM f GROUP BY ALL""",
    "record_faults": f"SELECT p_partkey, field, number, fault FROM part JOIN (VALUES {', '.join(f'({k}, {_QUOTE(f)}, CAST({n or 'NULL'} AS BIGINT), {_QUOTE(x)})' for k, (f, n, _, x) in enumerate(CASES) if x)}) c(k, field, number, fault) ON p_partkey % {len(CASES)} = k",
    "bases_to_read": f"""
        WITH {_DOCUMENTS},
        r AS (SELECT l_orderkey AS doc, l_linenumber, CAST(l_extendedprice AS DECIMAL(15,2)) AS amount, l_shipdate FROM lineitem WHERE l_linenumber > 1 OR l_orderkey % 4 = 0),
        a AS (SELECT doc, arg_max(amount, (epoch_us(l_shipdate), amount)) AS amount FROM r WHERE l_linenumber <= 2 GROUP BY 1)
        SELECT doc, tender, path, newest, coalesce(contents, '') AS contents, amount FROM b LEFT JOIN c USING (doc) LEFT JOIN a USING (doc)
        WHERE (path NOT ILIKE '%.zip' OR unpacked) AND NOT EXISTS (SELECT 1 FROM r WHERE r.doc = b.doc AND l_linenumber = 1)""",
    "newest_bases": f"WITH {_DOCUMENTS} SELECT tender, doc, coalesce(contents, '') AS contents FROM b LEFT JOIN c USING (doc) WHERE newest AND (path NOT ILIKE '%.zip' OR unpacked)",
    "queue_rows": f"""
        WITH {_DOCUMENTS}, t AS (SELECT doc, CASE WHEN NOT done THEN 'fetch' WHEN path ILIKE '%.zip' AND NOT unpacked THEN 'unpack' END AS todo FROM d)
        SELECT todo, doc, row_number() OVER (PARTITION BY todo ORDER BY doc) AS place FROM t WHERE todo IS NOT NULL""",
    "pending_urgent": """
        WITH t AS (SELECT o_orderkey, date_diff('day', DATE '2000-01-01', CAST(CASE WHEN o_orderkey % 13 > 0 THEN o_orderdate END AS DATE)) AS days FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
          WHERE o_orderstatus <> 'F' AND (c_custkey % 10 = 0 OR r_name IN ('ASIA', 'EUROPE')))
        SELECT o_orderkey, row_number() OVER (ORDER BY days NULLS LAST, o_orderkey) AS place FROM t""",
    "running_lines": f"""
        WITH p AS (SELECT c_custkey, c_mktsegment, c_custkey % 6 + 1 AS n, unnest(range(1, c_custkey % 6 + 2)) AS i FROM customer),
        b AS (SELECT *, translate(md5(concat_ws('-', c_custkey, i, 1)), '{_DIGITS}', '{_LETTERS}') AS one, translate(md5(concat_ws('-', c_custkey, i, 2)), '{_DIGITS}', '{_LETTERS}') AS two, CASE WHEN i % 2 = 0 THEN '      LICITACIÓN PÚBLICA' ELSE '' END AS beside FROM p),
        c AS (SELECT c_custkey, i, CASE WHEN n < 3 THEN 'MUNICIPALIDAD de ' || c_mktsegment || chr(10) || '  Página ' || i || ' de ' || n || chr(10) || chr(10) || one || beside || chr(10) || two || chr(10) || '   ' || i || chr(10) WHEN n = 6 THEN one || chr(10) || two ELSE one || beside || chr(10) || two END AS page FROM b)
        SELECT c_custkey, string_agg(page, chr(12) ORDER BY i) AS clean FROM c GROUP BY 1""",
    "untold_sentences": f"""
        WITH r AS (SELECT p_partkey AS k, p_partkey AS reading, p_partkey % 40 AS tender, p_retailprice AS price, p_brand AS brand, p_type AS type, p_size AS size FROM part WHERE p_partkey % 7 > 0 AND p_partkey % 5 > 0 AND p_partkey % 3 < 2),
        t AS (SELECT r.*, s_name AS title, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS questions, {_SINCE} AS since FROM r JOIN supplier ON s_suppkey = tender),
        l AS (
          SELECT *, 1 AS place, 'Experiencia pedida' AS field, {_MONEY} || CASE WHEN k % 3 = 0 THEN ' (1 vez' ELSE ' (1.5 veces' END || ' la cuantía) en ' || brand || ': Puentes o ' || type || CASE WHEN k % 4 = 0 THEN ' (tipología A o B)' ELSE '' END || '; últimos ' || (k % 20 + 1) || ' años desde ' || since AS text FROM t
          UNION ALL SELECT *, 2, 'Personal clave', 'Residente de obra (1): Ingeniero o Arquitecto, bachiller' || CASE WHEN k % 2 = 0 THEN ' colegiado' ELSE '' END || '; ' || size || ' meses' || CASE WHEN k % 3 = 0 THEN ' desde la colegiatura' ELSE '' END || ' como Jefe o Residente' || CASE WHEN k % 5 = 0 THEN ' en SSOMA' ELSE '' END || CASE WHEN k % 2 = 0 THEN '; en la especialidad y subespecialidad' ELSE '; en obras en general' END || '; últimos 20 años' FROM t
          UNION ALL SELECT *, 3, 'Factores de evaluación', 'K. Nombre' || CASE WHEN k % 2 = 0 THEN ', k.1' ELSE '' END || ' (máx. 100): ' || CASE k % 6
            WHEN 0 THEN 'Residente o Jefe con ' || CASE WHEN k % 2 = 0 THEN '1 año' ELSE '2 años' END || ' más de lo pedido; 50.5 % o más del personal evaluado → ' || size || '; 50.5 % o más del personal evaluado → ' || size
            WHEN 1 THEN CASE WHEN k % 2 = 0 THEN 'más de ' ELSE 'desde ' END || {_MONEY} || ' → ' || size || '; ' || CASE WHEN k % 2 = 0 THEN 'más de ' ELSE 'desde ' END || {_MONEY} || ' → ' || size || ' (últimos 10 años desde ' || since || ')'
            ELSE CASE k % 6 WHEN 2 THEN 'ISO' || CASE WHEN k % 4 = 2 THEN '' ELSE ', alcance pedido: obras' END WHEN 3 THEN 'BIM del Jefe' WHEN 4 THEN 'Software' ELSE 'lo juzga el comité: el plan' END || '; acredita → ' || size || '; acredita → ' || size END FROM t
          UNION ALL SELECT *, 4, 'Incongruencias', CASE WHEN k % 2 = 0 THEN 'Consulta: ' ELSE '' END || 'No coincide. Lectura usada: la tabla' || CASE WHEN k % 3 > 0 THEN '. Otra lectura: Factores de evaluación' || CASE WHEN k % 3 = 1 THEN ' K' ELSE '' END || ', puntos max = 25' ELSE '' END FROM t)
        SELECT reading, tender, title, CAST(questions AS BIGINT) AS questions, CAST(place AS BIGINT) AS place, field, text FROM l""",
}
