"""Upkeep of tracked tenders, import of hand-filled records, and readers over texts in several layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import amounts
from ..operators import factor_table, readers, records, requirements, state
from ..sources.tables import table


def deadline_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of orders' states and deadlines; where a seventh line says that the offer stage moved, the deadline's is not told again."""
    old = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("state"), F.col("o_orderdate").cast("date").alias("deadline"))
    key = F.col("o_orderkey")
    new = old.withColumns({"state": F.when(key % 5 == 0, "X").otherwise(F.col("state")), "deadline": F.when(key % 3 == 0, F.date_add("deadline", 1)).otherwise(F.col("deadline"))})
    moved = table(spark, sf_dir, "lineitem").filter("l_linenumber = 7").select(F.col("l_orderkey").alias("o_orderkey"))
    return state.without_echo(state.field_changes(old, new, ["o_orderkey"], ["state", "deadline"]), "deadline", moved, ["o_orderkey"]).select("o_orderkey", "field")


def last_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the latest of a change known before and of their orders' days."""
    known = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.lit("1995-01-01")).cast("date").alias("last_change"))
    changes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").cast("date").alias("at"))
    return state.with_last_change(known, changes, ["c_custkey"], "at").select("c_custkey", F.col("last_change").cast("string").alias("last_change"))


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a new reading does to the place of a tender, by where the old one came from; every fifth reading is doubted."""
    key = F.col("c_custkey")
    source = F.when(key % 4 == 0, "bases").when(key % 4 == 1, "entity").when(key % 4 == 2, "portal").otherwise("unknown")
    place = lambda rest, name: F.when(key % 3 == rest, F.array(F.lit(name)))
    old = F.when(source == "unknown", F.array().cast("array<string>")).otherwise(F.array(F.lit("PUNO")))
    new = state.located_over(source, old, place(0, "LIMA"), place(1, "CUSCO"), key % 5 == 0)
    return table(spark, sf_dir, "customer").select("c_custkey", new.alias("n")).select("c_custkey", F.array_join("n.regions", ",").alias("regions"), F.col("n.source").alias("source"))


def search_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches by nation: the first fifteen are configured, those from the tenth on are tracked since their first order."""
    nations = table(spark, sf_dir, "nation")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    tracked = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.min("o_orderdate").alias("since"))
    tracked = nations.filter("n_nationkey >= 10").join(tracked, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("n_name").alias("label"), "since")
    configured = nations.filter("n_nationkey < 15").select(F.lower("n_name").alias("label"))
    plan = state.search_plan(configured, tracked, "label", "since", F.lit("1998-01-01").cast("date"), 900)
    return plan.select("label", F.col("first_day").cast("string").alias("first_day"))


def _imported(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    stored = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("fields"), F.col("c_nationkey").cast("long").alias("reported"))
    key = F.col("c_custkey")
    filled = stored.select("c_custkey", F.when(key % 4 == 0, "X").otherwise(F.col("fields")).alias("fields"), F.when(key % 7 > 0, key % 3 > 0).alias("ready"))
    documents = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return records.import_ready(filled, documents, stored, ["c_custkey"], "fields", "reported")


def import_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand-filled records taken in: those that differ replace what is stored and are to be reported anew."""
    return _imported(spark, sf_dir)[0]


def import_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand-filled records whose document is not listed."""
    return _imported(spark, sf_dir)[1].select("c_custkey", "fields")


def incongruence_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight kinds of incongruences, five of them faulty and one for every third part."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_size").cast("string").alias("size"), F.col("p_size"))
    cell = lambda *x: F.struct(*(v.alias(n) for v, n in zip((F.lit(y) if isinstance(y, str) else y for y in x), ("field", "row", "column", "value"), strict=True)))
    values = parts.select("p_partkey", F.explode(F.array(cell("amount", "", "monto", F.col("size")), cell("staff", F.col("p_brand"), "meses", F.col("size")))).alias("v")).select("p_partkey", "v.*")
    key = F.col("p_partkey")
    other = F.when(key % 3 == 0, F.col("size")).otherwise((F.col("p_size") + 1).cast("string"))
    kinds = [cell("", "", "", "x"), cell("", "", "", ""), cell("amount", "", "", "5"), cell("nada", "", "monto", "5"), cell("amount", "r", "monto", "5"), cell("staff", "zz", "", ""), cell("staff", F.col("p_brand"), "nada", "1"), cell("staff", F.col("p_brand"), "meses", other)]
    named = parts.select("p_partkey", F.get(F.array(*kinds), (key % 8).cast("int")).alias("n")).select("p_partkey", "n.*")
    return records.incongruence_faults(named, values, ["p_partkey"], ["amount"]).select("p_partkey", "message")


def _text(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def _dealt(df: DataFrame, key: str) -> DataFrame:
    """The texts made of these rows are far larger than they are: deal the rows over the cores first."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def reader_factor_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary tables in five layouts: lettered, with bullets, names alone, a figure carried past an unused row, a misread figure that the description mends."""
    key, a, b = F.col("p_partkey"), F.col("p_size").cast("string"), (100 - F.col("p_size")).cast("string")
    title, end = "CUADRO RESUMEN DE LOS FACTORES DE EVALUACIÓN\n FACTOR    PUNTAJE\n", "\nPUNTAJE TOTAL    100 puntos\n"
    made = (
        F.when(key % 5 == 0, _text("x\x0c", title, " A. EXPERIENCIA DEL POSTOR    ", a, " puntos\n B INTEGRIDAD EN LA\n   CONTRATACIÓN    [", b, "] puntos", end))
        .when(key % 5 == 1, _text("x\x0c", title, " o EXPERIENCIA DEL POSTOR    ", a, " puntos\n • INTEGRIDAD    ", b, " puntos", end))
        .when(key % 5 == 2, _text("x\x0c", title, "EXPERIENCIA DEL POSTOR\n", a, " puntos\nINTEGRIDAD\n", b, " puntos", end))
        .when(key % 5 == 3, _text("x\x0c", title, "A. GESTIÓN DE RIESGOS   NO CORRESPONDE\n   ", a, " puntos\nB. EXPERIENCIA DEL POSTOR\nC. INTEGRIDAD    ", b, " puntos", end))
        .otherwise(_text("EVALUACIÓN TÉCNICA\nA. EXPERIENCIA DEL POSTOR\nEvaluación:\n ", a, " puntos\n\x0c", title, "A. EXPERIENCIA DEL POSTOR    1", a, " puntos\nB. INTEGRIDAD    ", b, " puntos", end))
    )
    read = factor_table.read_factors(_dealt(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", made.alias("text")))
    r = F.col("factors")
    shown = F.array_join(F.transform(r["factors"], lambda x: F.concat_ws(":", x["name"], x["points"])), ";")
    return read.select("p_partkey", r["page"].cast("long").alias("page"), shown.alias("shown"), r["sum"].cast("long").alias("sum"), F.array_join(r["warnings"]["warning"], ",").alias("warnings"), r["review"].alias("review"))


def reader_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of limits in three layouts: columns whose amounts stand on lines of their own, with and without taxes, and a row a line."""
    orders = _dealt(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast(amounts.MONEY).alias("total")), "o_orderkey")
    key, total = F.col("o_orderkey"), F.col("total")
    low, high = amounts.lower_limit(total), amounts.upper_limit(total)
    written = lambda c: F.format_number(c, 2)
    less = lambda c: F.floor(c * F.lit("0.85").cast("decimal(3,2)"), F.lit(2)).cast(amounts.MONEY)
    at = lambda c, n: F.rpad(F.lit(c) if isinstance(c, str) else c, n, " ")
    heads = _text(at("CUANTÍA DE LA CONTRATACIÓN", 40), at("LÍMITE INFERIOR", 30), "LÍMITE SUPERIOR\n")
    spread = _text(heads, "S/ ", written(total), "\n", at(" ", 40), written(low), "\n", at(" ", 70), written(high), "\n")
    taxed = _text(heads, at(" ", 38), at("con IGV", 15), at("sin IGV", 15), at("con IGV", 15), "sin IGV\n", at(written(total), 38), at(written(low), 15), at(written(less(low)), 15), at(written(high), 15), written(less(high)), "\n")
    by_cell = _text("CONTRATACIÓN    LÍMITE INFERIOR    LÍMITE SUPERIOR\n", written(total), "    S/ ", written(low), "    S/ ", written(high), "\n")
    made = _text("1.4 CUANTÍA DE LA CONTRATACIÓN\nLa cuantía asciende a S/ ", written(total), ", con impuestos.\n", F.when(key % 3 == 0, spread).when(key % 3 == 1, taxed).otherwise(by_cell), "OBLIGACIONES\n")
    read = readers.read_amount(orders.select("o_orderkey", made.alias("text")))
    return read.select("o_orderkey", *(F.col(f"amount.{c}").alias(c) for c in ("amount", "lower_limit", "upper_limit", "lower_without_tax", "upper_without_tax", "review")), F.size("amount.warnings").cast("long").alias("n_warnings"))


def reader_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chapters of posts and of factors, on which page each stands; every third text has one, or none."""
    key = F.col("p_partkey")
    general = "CAPÍTULO III\nel personal clave\nCAPÍTULO IV\nde otra cosa\n" + "relleno " * 600 + "\x0c"
    posts = "CAPÍTULO III\nREQUERIMIENTO\n\x0cCAPACIDAD TÉCNICA\nB.2 EXPERIENCIA DEL PERSONAL CLAVE\nRequisitos:\nRESIDENTE DE OBRA 12 meses\nAcreditación: x\n\x0c"
    factors = "CAPÍTULO IV\nFACTORES DE EVALUACIÓN\n" + "puntaje " * 300 + "\nCAPÍTULO V\nfin"
    made = F.when(key % 3 == 0, _text(general, posts, factors)).when(key % 3 == 1, _text(general, factors)).otherwise(_text(general))
    read = requirements.find_chapters(_dealt(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", made.alias("text")))
    c = F.col("chapters")
    return read.select("p_partkey", c["personnel_page"].cast("long").alias("personnel_page"), c["factors_page"].cast("long").alias("factors_page"), (c["factors_end"] - c["factors_at"]).cast("long").alias("n_factors"), c["review"].alias("review"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("int").alias("n"))
    return lines.withColumn("name", F.concat(F.lit("factor "), "l_linenumber"))


def factors_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points read in a chapter against those of the table; every fifth order's are one off, and second lines are missing from the table."""
    lines = _lines(spark, sf_dir)
    answers = lines.select("l_orderkey", "name", (F.col("n") + F.when(F.col("l_orderkey") % 5 == 0, 1).otherwise(0)).alias("n"))
    return requirements.checked_factors(answers, lines.filter("l_linenumber <> 2").select("l_orderkey", "name", "n"), ["l_orderkey"], "name", "n").select("l_orderkey", "name", "checked")


def months_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months asked of posts, in order, against those of the table; the table lacks those of 30 and more."""
    lines = _lines(spark, sf_dir)
    return requirements.checked_months(lines, lines.withColumn("n", F.when(F.col("n") < 30, F.col("n"))), ["l_orderkey"], "l_linenumber", "n")


QUERIES = {f.__name__: f for f in (
    deadline_changes, last_changes, locations, search_plan, import_ready, import_refused, incongruence_faults, reader_factor_layouts, reader_limits, reader_chapters, factors_checked, months_checked,
)}

_CENTS = "CAST(CAST(o_totalprice AS DECIMAL(15,2)) * 100 AS BIGINT)"
_LINES = "(SELECT l_orderkey, l_linenumber, CAST(max(l_quantity) AS INT) AS n FROM lineitem GROUP BY 1, 2)"
_TAKEN = "c_custkey % 7 > 0 AND c_custkey % 3 > 0 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')"
ORACLE_SQL = {
    "deadline_changes": """
        SELECT o_orderkey, 'state' AS field FROM orders WHERE o_orderkey % 5 = 0 UNION ALL
        SELECT o_orderkey, 'deadline' FROM orders WHERE o_orderkey % 3 = 0 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 7)""",
    "last_changes": """
        SELECT c_custkey, CAST(greatest(CASE WHEN c_custkey % 2 = 0 THEN DATE '1995-01-01' END, (SELECT CAST(max(o_orderdate) AS DATE) FROM orders WHERE o_custkey = c_custkey)) AS VARCHAR) AS last_change FROM customer""",
    "locations": """
        WITH s AS (SELECT c_custkey, c_custkey % 4 AS s, c_custkey % 3 AS n, c_custkey % 5 = 0 AS doubted FROM customer)
        SELECT c_custkey, CASE WHEN doubted THEN CASE WHEN s IN (0, 3) THEN '' ELSE 'PUNO' END WHEN n = 0 AND s <> 2 THEN 'LIMA' WHEN n = 1 AND s IN (0, 3) THEN 'CUSCO' WHEN s = 3 THEN '' ELSE 'PUNO' END AS regions,
          CASE WHEN doubted THEN CASE s WHEN 0 THEN 'unknown' WHEN 1 THEN 'entity' WHEN 2 THEN 'portal' ELSE 'unknown' END WHEN (n = 0 AND s <> 2) OR (n = 1 AND s IN (0, 3)) THEN 'bases'
            ELSE CASE s WHEN 0 THEN 'bases' WHEN 1 THEN 'entity' WHEN 2 THEN 'portal' ELSE 'unknown' END END AS source FROM s""",
    "search_plan": """
        WITH t AS (SELECT c_nationkey, CAST(min(o_orderdate) AS DATE) AS since FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
        SELECT CASE WHEN n_nationkey < 15 THEN lower(n_name) ELSE n_name END AS label, CAST(least(DATE '1998-01-01' - 900, coalesce(CASE WHEN n_nationkey >= 10 THEN since END, DATE '1998-01-01')) AS VARCHAR) AS first_day
        FROM nation LEFT JOIN t ON c_nationkey = n_nationkey WHERE n_nationkey < 15 OR since IS NOT NULL""",
    "import_ready": f"""
        SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 AND {_TAKEN} THEN 'X' ELSE c_mktsegment END AS fields, CASE WHEN NOT (c_custkey % 4 = 0 AND {_TAKEN}) THEN CAST(c_nationkey AS BIGINT) END AS reported FROM customer""",
    "import_refused": """
        SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'X' ELSE c_mktsegment END AS fields FROM customer WHERE c_custkey % 7 > 0 AND c_custkey % 3 > 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""",
    "incongruence_faults": """
        SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'value without field and column' WHEN 2 THEN 'value without column' WHEN 3 THEN 'unknown field' WHEN 4 THEN 'a block has no rows' WHEN 5 THEN 'unknown row' WHEN 6 THEN 'unknown column' WHEN 7 THEN 'value is the reading already used' END AS message
        FROM part WHERE p_partkey % 8 <> 1 AND (p_partkey % 8 <> 7 OR p_partkey % 3 = 0)""",
    "reader_factor_layouts": """
        SELECT p_partkey, CAST(2 AS BIGINT) AS page, 'Experiencia adicional del postor en la especialidad:' || p_size || ';Integridad en la contratación pública:' || (100 - p_size) AS shown, CAST(100 AS BIGINT) AS sum,
          CASE WHEN p_partkey % 5 = 4 AND p_size < 10 THEN 'puntaje_distinto' ELSE '' END AS warnings, CAST(NULL AS VARCHAR) AS review FROM part""",
    "reader_limits": f"""
        WITH c AS (SELECT o_orderkey, {_CENTS} AS c, ({_CENTS} * 95 + 99) // 100 AS lo, {_CENTS} * 110 // 100 AS hi FROM orders), m AS (SELECT *, CASE WHEN o_orderkey % 3 = 1 THEN lo * 85 // 100 END AS lw, CASE WHEN o_orderkey % 3 = 1 THEN hi * 85 // 100 END AS hw FROM c)
        SELECT o_orderkey, {', '.join(f"CAST({x} * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(15,2)) AS {n}" for x, n in (('c', 'amount'), ('lo', 'lower_limit'), ('hi', 'upper_limit'), ('lw', 'lower_without_tax'), ('hw', 'upper_without_tax')))},
          CAST(NULL AS VARCHAR) AS review, CAST(0 AS BIGINT) AS n_warnings FROM m""",
    "reader_chapters": """
        SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CAST(3 AS BIGINT) END AS personnel_page, CASE p_partkey % 3 WHEN 0 THEN CAST(4 AS BIGINT) WHEN 1 THEN CAST(2 AS BIGINT) END AS factors_page,
          CASE WHEN p_partkey % 3 < 2 THEN CAST(2436 AS BIGINT) END AS n_factors, CASE WHEN p_partkey % 3 = 2 THEN 'sin capítulos III ni IV legibles' END AS review FROM part""",
    "factors_checked": f"SELECT l_orderkey, 'factor ' || l_linenumber AS name, l_orderkey % 5 > 0 AND l_linenumber <> 2 AS checked FROM {_LINES}",
    "months_checked": f"SELECT l_orderkey, bool_and(n < 30) AS checked FROM {_LINES} GROUP BY 1",
}
