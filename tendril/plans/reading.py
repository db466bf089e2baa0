"""Readers over synthetic documents, one for each order: what a document says is made from the order's own columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import amounts, text
from ..operators import factor_table, more_readers, personnel, readers
from ..sources.tables import table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nid, total, file, scan, text: some lack the section, some have limits off by a cent, some leave the template's choice."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("nid"), F.col("o_totalprice").cast(amounts.MONEY).alias("total"))
    # the texts made below are far larger than these rows: deal the rows, not the texts, over the cores
    orders = orders.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "nid")
    money = lambda c: F.concat(F.lit("S/ "), F.format_number(c, 2))
    nid, total = F.col("nid"), F.col("total")
    cent = F.when(nid % 7 == 0, F.lit("0.01")).otherwise("0.00").cast(amounts.MONEY)
    table_ = F.concat(F.lit("CUANTÍA DE LA\n CONTRATACIÓN    LIMITE INFERIOR    LIMITE SUPERIOR\n  "), money(total), F.lit("    "), money(amounts.lower_limit(total) - cent), F.lit("    "), money(amounts.upper_limit(total)), F.lit("\n"))
    offer = F.when(nid % 5 == 0, "[SEÑALAR FIJA O LIMITADA]").when(nid % 3 == 0, "FIJA").otherwise("LIMITADA")
    whole = F.concat(
        F.lit("1.4 CUANTÍA DE LA CONTRATACIÓN\nLa cuantía asciende a "), money(total), F.lit(", con impuestos.\n\x0c"), F.when(nid % 3 > 0, table_).otherwise(""), F.lit("OBLIGACIONES\n\x0c"),
        F.lit("EXPERIENCIA DEL POSTOR EN LA ESPECIALIDAD\nRequisitos:\nUn monto facturado acumulado equivalente a "), F.when(nid % 2 == 0, "una (1) vez la cuantía").otherwise(money(total)), F.lit(", durante los diez (10) años anteriores.\nEspecialidad: Viales\nAcreditación: x\n"),
        F.lit("en el presente procedimiento de selección es:\n "), offer, F.lit("\n"),
    )
    said = F.when(nid % 11 == 0, F.lit("sin nada")).otherwise(whole)
    files = F.array(F.struct(F.lit(1).alias("file"), (nid % 22 == 0).alias("scan"), F.when(nid % 4 == 0, F.lit("anexo")).otherwise(said).alias("text")), F.struct(F.lit(2).alias("file"), F.lit(False).alias("scan"), said.alias("text")))
    return orders.select("nid", "total", F.explode(files).alias("f")).select("nid", "total", "f.*")


def reader_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = readers.read_amount(documents(spark, sf_dir).filter("file = 2"), stated="total")
    r = F.col("amount")
    return read.select("nid", r["page"].cast("long").alias("page"), r["amount"].alias("amount"), r["offer_type"].alias("offer_type"), r["lower_limit"].alias("lower_limit"), r["upper_limit"].alias("upper_limit"), F.array_join(r["warnings"]["warning"], ",").alias("warnings"), r["review"].alias("review"))


def reader_experience(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = readers.read_experience(documents(spark, sf_dir).filter("file = 2"), amount="total")
    r = F.col("experience")
    return read.select("nid", r["page"].cast("long").alias("page"), r["amount"].alias("amount"), r["years"].alias("years"), r["specialty"].alias("specialty"), r["review"].alias("review"))


def reading_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = readers.read_amount(documents(spark, sf_dir))
    found = readers.read_chain(read, "nid", "amount", readers.NO_SECTION, [F.asc("file")], "scan")
    return found.select("nid", F.col("amount.amount").alias("amount"), "review")


def reader_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of works made from parts: in typographic quotes, in straight ones, and in none; every seventh code differs from the portal's."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    key, long = F.col("p_partkey"), F.concat(F.lit("MEJORAMIENTO DEL "), F.upper("p_type"))
    code = (F.lit(2_000_000) + key).cast("string")
    name = F.when(key % 3 == 0, F.concat(F.lit("obra: “"), long, F.lit("”, con CUI "), code)).when(key % 3 == 1, F.concat(F.lit('obra "'), long, F.lit('" CUI N° '), code)).otherwise(F.concat(F.lit("obra: "), long, F.lit(", con CUI "), code))
    said = F.concat(F.lower(long), F.lit(" CUI "), F.when(key % 7 == 0, "9999999").otherwise(code))
    documents = parts.select("p_partkey", F.concat(F.lit("1.3 OBJETO DE LA CONVOCATORIA\n El procedimiento tiene por objeto la ejecución de la "), name, F.lit("\n1.4 x")).alias("text"), said.alias("said"))
    r = F.col("object")
    return more_readers.read_object(documents, description="said").select("p_partkey", r["name"].alias("name"), r["code"].alias("code"), F.array_join(r["warnings"]["warning"], ",").alias("warnings"), r["review"].alias("review"))


def reader_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary tables made from the lines of orders: a row a line, its quantity as points, the sum stated, off by one for every ninth order."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.col("l_quantity").cast("int")).alias("points"))
    row = F.concat(F.lit(" "), F.chr(F.lit(64) + F.col("l_linenumber")), F.lit(". MEJORA      "), F.col("points").cast("string"), F.lit(" puntos"))
    made = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", row.alias("row")))).alias("rows"), F.sum("points").alias("total"))
    stated = F.col("total") + F.when(F.col("l_orderkey") % 9 == 0, 1).otherwise(0)
    documents = made.select("l_orderkey", F.concat(F.lit("CUADRO RESUMEN DE LOS FACTORES DE EVALUACIÓN\n"), F.array_join(F.transform("rows", lambda x: x["row"]), "\n"), F.lit("\nPUNTAJE TOTAL  "), stated.cast("string"), F.lit(" puntos\n")).alias("text"))
    r = F.col("factors")
    return factor_table.read_factors(documents).select("l_orderkey", F.size(r["factors"]).cast("long").alias("n"), r["total"].cast("long").alias("total"), r["sum"].cast("long").alias("sum"), F.array_join(r["warnings"]["warning"], ",").alias("warnings"), r["review"].alias("review"))


def reader_personnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements of two posts made from parts, in five layouts, one that no layout reads, and none at all."""
    key, n = F.col("p_partkey"), F.col("p_size").cast("string")
    twice = (F.col("p_size") * 2).cast("string")
    title = "\x0cB.2 EXPERIENCIA DEL PERSONAL CLAVE\nRequisitos:\n"
    end = "\nAcreditación: con contratos de 99 meses"
    joined = lambda *parts: F.concat(*(p if isinstance(p, F.Column) else F.lit(p) for p in parts))
    made = (
        F.when(key % 7 == 0, joined(title, "1. RESIDENTE DE OBRA\n  Experiencia    ", n, " meses\n2. ESPECIALISTA EN SUELOS\n  Experiencia    ", twice, " meses", end))
        .when(key % 7 == 1, joined(title, "a) Residente de Obra\nAcredita doce (", n, ") meses en obras similares.\nb) Especialista en Suelos:\nAcredita ", twice, " años.", end))
        .when(key % 7 == 2, joined(title, "Residente de Obra\n", n, " meses de experiencia como residente\nEspecialista en Suelos\n", twice, " meses de experiencia", end))
        .when(key % 7 == 3, joined(title, "N°    CARGO    EXPERIENCIA\n1    RESIDENTE DE OBRA    ", n, " meses\n2    ESPECIALISTA EN SUELOS    ", twice, " meses (", twice, ") meses", end))
        .when(key % 7 == 4, joined(title, "CARGO               EXPERIENCIA\nRESIDENTE DE        ", n, " meses en obras similares\nOBRA                computados desde la colegiatura\nESPECIALISTA EN     ", twice, " meses en obras similares\nSUELOS              computados desde la colegiatura", end))
        .when(key % 7 == 5, joined(title, "Se piden ", n, " meses y ", twice, " meses", end))
        .otherwise("EXPERIENCIA DEL PERSONAL CLAVE, factor con PUNTAJE")
    )
    read = personnel.read_personnel(table(spark, sf_dir, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey").select("p_partkey", made.alias("text")))
    r = F.col("personnel")
    staff = F.array_join(F.transform(r["staff"], lambda x: F.concat_ws(":", F.coalesce(x["post"], F.lit("?")), x["time"], x["months"])), ";")
    warned = F.array_join(F.transform(r["warnings"], lambda w: F.concat_ws(":", w["warning"], w["stated"], w["expected"])), ";")
    return read.select("p_partkey", r["page"].cast("long").alias("page"), staff.alias("staff"), warned.alias("warnings"), r["review"].alias("review"))


def text_tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return parts.select("p_partkey", text.tidy(F.concat_ws(" ; ", "p_type", "p_name")).alias("tidy"), text.work_name(F.concat(F.lit("Ejecución de la obra: "), F.col("p_name"), F.lit(", CUI 2345678"))).alias("work"))


QUERIES = {f.__name__: f for f in (reader_amount, reader_experience, reading_chain, reader_object, reader_factors, reader_personnel, text_tidy)}

_TOTAL = "CAST(o_totalprice AS DECIMAL(15,2))"
_LOW = f"CAST((CAST({_TOTAL} * 100 AS BIGINT) * 95 + 99) // 100 * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(15,2))"
_HIGH = f"CAST(CAST({_TOTAL} * 100 AS BIGINT) * 110 // 100 * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(15,2))"
ORACLE_SQL = {
    "text_tidy": "SELECT p_partkey, p_type || ', ' || p_name AS tidy, p_name AS work FROM part",
    "reader_personnel": """
        WITH p AS (SELECT p_partkey, p_partkey % 7 AS k, p_size AS n, 2 * p_size AS m FROM part),
        t AS (SELECT *, n || CASE WHEN n = 1 THEN ' mes:' ELSE ' meses:' END || n AS a, CASE WHEN k = 1 THEN m || ' años:' || 12 * m ELSE m || ' meses:' || m END AS b,
          CASE WHEN k IN (1, 2) THEN 'Residente de Obra:' WHEN k = 5 THEN '?:' ELSE 'RESIDENTE DE OBRA:' END AS one, CASE WHEN k IN (1, 2) THEN 'Especialista en Suelos:' WHEN k = 5 THEN '?:' ELSE 'ESPECIALISTA EN SUELOS:' END AS two FROM p)
        SELECT p_partkey, CASE WHEN k < 6 THEN CAST(2 AS BIGINT) END AS page, CASE WHEN k < 6 THEN one || a || ';' || two || b ELSE '' END AS staff,
          CASE WHEN k = 1 AND n <> 12 THEN 'tiempo_distinto_letras:' || n || ':12' ELSE '' END AS warnings,
          CASE k WHEN 5 THEN 'cargos ilegibles' WHEN 6 THEN 'sin requisito de personal clave' END AS review FROM t""",
    "reader_amount": f"""
        SELECT o_orderkey AS nid, CASE WHEN o_orderkey % 11 > 0 THEN CAST(1 AS BIGINT) END AS page, CASE WHEN o_orderkey % 11 > 0 THEN {_TOTAL} END AS amount,
          CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'sin rellenar' WHEN o_orderkey % 3 = 0 THEN 'fija' ELSE 'limitada' END AS offer_type,
          CASE WHEN o_orderkey % 11 > 0 AND o_orderkey % 3 > 0 THEN CAST({_LOW} - CASE WHEN o_orderkey % 7 = 0 THEN 0.01 ELSE 0.00 END AS DECIMAL(15,2)) END AS lower_limit,
          CASE WHEN o_orderkey % 11 > 0 AND o_orderkey % 3 > 0 THEN {_HIGH} END AS upper_limit,
          CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE concat_ws(',', CASE WHEN o_orderkey % 5 = 0 THEN 'tipo_oferta_sin_rellenar' END, CASE WHEN o_orderkey % 3 > 0 AND o_orderkey % 7 = 0 THEN 'limite_inferior' END) END AS warnings,
          CASE WHEN o_orderkey % 11 = 0 THEN 'sin sección 1.4' END AS review FROM orders""",
    "reader_experience": f"""
        SELECT o_orderkey AS nid, CASE WHEN o_orderkey % 11 > 0 THEN CAST(3 AS BIGINT) END AS page, CASE WHEN o_orderkey % 11 > 0 THEN {_TOTAL} END AS amount, CASE WHEN o_orderkey % 11 > 0 THEN CAST(10 AS BIGINT) END AS years,
          CASE WHEN o_orderkey % 11 > 0 THEN 'Viales' END AS specialty, CASE WHEN o_orderkey % 11 = 0 THEN 'sin requisito de experiencia del postor' END AS review FROM orders""",
    "reader_object": """
        SELECT p_partkey, 'MEJORAMIENTO DEL ' || upper(p_type) AS name, CAST(2000000 + p_partkey AS VARCHAR) AS code, CASE WHEN p_partkey % 7 = 0 THEN 'cui_distinto_seace' ELSE '' END AS warnings, CAST(NULL AS VARCHAR) AS review FROM part""",
    "reader_factors": """
        WITH l AS (SELECT l_orderkey, l_linenumber, max(CAST(l_quantity AS INT)) AS points FROM lineitem GROUP BY 1, 2),
        o AS (SELECT l_orderkey, count(*) AS n, CAST(sum(points) AS BIGINT) AS sum, CAST(sum(points) AS BIGINT) + CASE WHEN l_orderkey % 9 = 0 THEN 1 ELSE 0 END AS total FROM l GROUP BY 1)
        SELECT l_orderkey, n, total, sum, concat_ws(',', CASE WHEN sum <> total THEN 'suma_distinta_total' END, CASE WHEN total <> 100 THEN 'total_distinto_100' END) AS warnings, CAST(NULL AS VARCHAR) AS review FROM o""",
    "reading_chain": f"""
        SELECT o_orderkey AS nid, CASE WHEN o_orderkey % 11 > 0 THEN {_TOTAL} END AS amount,
          CASE WHEN o_orderkey % 22 = 0 THEN 'documento escaneado' WHEN o_orderkey % 11 = 0 THEN 'sin sección 1.4' END AS review FROM orders""",
}
