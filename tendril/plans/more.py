"""Look-ups, predicates and serving views on the driver's tables: orders stand for tenders, lineitem for documents, events for readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import amounts, dates
from ..operators import filters, lookups, ranking
from ..sources.tables import table
from .report import DOCUMENT_ORDER, NOW, _DOCUMENT_SQL, now


def like_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_type")
    return table(spark, sf_dir, "part").select("p_partkey", lookups.like_any(p, ["promo%", "%STEEL"]).alias("any_of"), lookups.like_none(p, ["%brass%", "small%"]).alias("none_of"), p.ilike("Econ%").alias("ilike"), lookups.matches(p, "an?o[dn]ized").alias("regex"))


def plain_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", lookups.plain_like(F.col("text"), "%etre%").alias("found"))


def state_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with orders of which none is finished, and whether the states overlap the watched ones or are none."""
    states = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderstatus")).alias("states"))
    both = table(spark, sf_dir, "customer").join(states, F.col("c_custkey") == F.col("o_custkey"), "left")
    return both.select("c_custkey", F.coalesce(lookups.lacks(F.col("states"), "F"), F.lit(False)).alias("lacks_f"), filters.overlaps_or_empty(F.col("states"), ["p", "O"]).alias("watched"))


def has_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "R", "Bases Íntegradas").when(F.col("l_returnflag") == "A", "BÁSES").otherwise("Acta")
    docs = table(spark, sf_dir, "lineitem").withColumn("kind", kind).withColumn("uuid", F.when(F.col("l_linestatus") == "F", F.col("l_partkey")))
    return docs.groupBy("l_orderkey").agg(lookups.has_bases(F.col("kind"), F.col("uuid")).alias("has_bases"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


def null_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without any document yet, or whose first was never received."""
    first = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.when(F.col("l_returnflag") != "N", F.col("l_shipdate"))).alias("received"), F.count("*").alias("n"))
    joined = table(spark, sf_dir, "orders").join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.filter("received is null").select("o_orderkey", F.col("n").isNull().alias("no_document"))


def json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path of a JSON column, a nested object within other words (one in nine is broken), and a JSONP answer."""
    events = table(spark, sf_dir, "events")
    said = F.concat(F.lit("Aquí está:\n{\"a\": {\"b\": ["), F.col("props"), F.lit("]}"), F.when(F.col("event_id") % 9 > 0, "}").otherwise(""), F.lit(" y más"))
    return events.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object(lookups.first_object(said), "$.a.b[0].k").alias("within"), F.get_json_object(lookups.jsonp(F.concat(F.lit("cb_1("), F.col("props"), F.lit(");"))), "$.k").alias("answered"), F.array(F.col("event_type")).alias("as_array"))


def docx_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = F.concat(F.col("l_shipdate").cast("string"), F.when(F.col("l_returnflag") == "R", ".DOCX").when(F.col("l_returnflag") == "A", ".pdf"))
    return table(spark, sf_dir, "lineitem").groupBy(file.alias("file")).agg(F.max("l_linenumber").alias("at")).select("file", lookups.page_unless_docx(F.col("at"), F.col("file")).cast("long").alias("page"))


def factor_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*(F.lit(w.lower() + "x") for w, _ in lookups.FACTORS), F.lit("otra cosa"))
    said = F.concat_ws(" ", F.get(words, (F.col("p_partkey") % 17).cast("int")), F.get(words, (F.col("p_size") % 17).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", lookups.named(said, otherwise=lookups.UNNAMED).alias("factor"))


def paired_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of an order's lines with its flags, place by place, where there are as many of both."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("numbers"))
    kinds = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_returnflag"))).alias("flags"))
    both = lines.join(kinds, "l_orderkey").withColumn("pairs", lookups.paired_by_place(F.col("numbers"), F.col("flags"))).filter("pairs is not null")
    return both.select("l_orderkey", F.array_join(F.transform("pairs", lambda p: F.concat_ws("=", p["first"], p["second"])), ",").alias("pairs"))


def column_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").cast("long").alias("start"))
    return lookups.most_common_starts(starts, ["l_suppkey"], "start")


def recent_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the same user in the hour up to each event."""
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    hour = Window.partitionBy("user_id").orderBy(seconds).rangeBetween(-3600, 0)
    return table(spark, sf_dir, "events").select("event_id", F.count("*").over(hour).alias("recent"))


def new_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct kinds of events of each user, in the order in which they first came."""
    firsts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    listed = firsts.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("first", "event_type"))).alias("x"))
    return listed.select("user_id", F.array_join(F.transform("x", lambda v: v["event_type"]), ",").alias("types"))


def changes_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open ones first, then by limit, those without one last; and, in the same table, newest first."""
    orders = table(spark, sf_dir, "orders").withColumn("limit", F.when(F.col("o_orderkey") % 10 > 0, F.col("o_orderdate")))
    closed, day = F.col("o_orderstatus") != "O", F.unix_date(F.to_date("limit"))
    without = F.when(F.col("limit").isNull(), F.col("o_orderkey"))  # those without a limit are in the order of their keys
    placed = ranking.global_place(orders, [closed.cast("int"), day, ranking.quantile_step(orders, without)], [closed.asc(), F.col("limit").asc_nulls_last(), F.col("o_orderkey").asc()])
    newest = ranking.global_place(placed, [-day, ranking.quantile_step(orders, -without)], [F.col("limit").desc_nulls_last(), F.col("o_orderkey").desc()], name="newest")
    return newest.select("o_orderkey", F.col("place").cast("long").alias("place"), F.col("newest").cast("long").alias("newest"))


def history_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of each user, newest first; and files called as bases before others, else as they came."""
    events = table(spark, sf_dir, "events")
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    stable = Window.partitionBy("user_id").orderBy((F.col("event_type") == "view").desc(), "event_id")
    return events.select("event_id", F.row_number().over(newest).cast("long").alias("newest"), F.row_number().over(stable).cast("long").alias("stable"))


def base_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tender with its newest document and the newest reading of five kinds, and its warnings counted without those read from images."""
    orders = table(spark, sf_dir, "orders")
    order = [(F.col("l_returnflag") == "R").desc(), F.col("l_shipdate").desc_nulls_last(), *(F.col(c).desc() for c in DOCUMENT_ORDER)]
    newest = ranking.newest_per_group(table(spark, sf_dir, "lineitem"), ["l_orderkey"], order).select("l_orderkey", "l_linenumber", "l_returnflag")
    kinds = ("click", "view", "purchase", "error", "signup")
    events = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    readings = ranking.latest_values(events, ["user_id"], "event_type", "value", F.col("at"), kinds)
    open_ = F.coalesce((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS") > now()), F.lit(False))
    joined = orders.join(newest, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(readings, F.col("o_custkey") == F.col("user_id"), "left")
    scanned = F.col("l_returnflag") == "N"
    doubtful = lambda k: F.coalesce(F.col(k) > 50, F.lit(False))
    warnings = lambda k: F.when(doubtful(k), F.array(F.lit(k)))
    warned = sum((F.when(filters.flagged(warnings(k), scanned, trusted=k == "purchase"), 1).otherwise(0) for k in kinds), F.lit(0))
    return joined.select(
        "o_orderkey", open_.alias("is_open"), F.col("l_linenumber").cast("long").alias("document"), *(F.col(k).alias(k) for k in kinds),
        F.coalesce(F.when(doubtful("click"), F.col("click").cast(amounts.MONEY)), F.col("o_totalprice").cast(amounts.MONEY)).alias("amount"),
        warned.cast("long").alias("n_warnings"),
    )


def detail_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the page of a tender shows: documents newest first, its stages in order with where the last one moved, and its history."""
    docs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_shipdate", "l_linenumber", "l_partkey")), asc=False).alias("d"))
    stages = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_stage"), F.count("*").alias("n_history"))
    joined = table(spark, sf_dir, "orders").join(docs, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(stages, F.col("o_custkey") == F.col("user_id"), "left")
    return joined.select("o_orderkey", F.array_join(F.transform("d", lambda x: x["l_partkey"].cast("string")), ",").alias("documents"), "last_stage", F.coalesce("n_history", F.lit(0)).alias("n_history"), dates.days_until(F.col("o_orderdate"), now()).alias("days_left"))


def queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is to be done with each document: fetch, unpack, read, or nothing."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat(F.lit("f"), F.when(F.col("l_returnflag") == "R", ".ZIP").when(F.col("l_returnflag") == "A", ".pdf").otherwise(".txt")).alias("file"), F.col("l_linestatus").alias("state")).distinct()
    archive = lookups.like_any(F.col("file"), ["%.zip", "%.rar", "%.7z"])
    todo = F.when(F.col("state") == "O", "fetch").when(archive, "unpack").when(lookups.like_any(F.col("file"), ["%.pdf", "%.docx"]), "read").otherwise("nothing")
    return lines.groupBy(todo.alias("todo")).agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("n_tenders"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a tender's earlier readings hold anything at all, and whether its key is in a given list."""
    known = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_orderkey").alias("key")).distinct().withColumn("seen", F.lit(True))
    listed = F.broadcast(spark.createDataFrame([(k,) for k in range(0, 100, 7)], "wanted long"))
    orders = table(spark, sf_dir, "orders").join(listed.withColumn("in_list", F.lit(True)), F.col("o_orderkey") == F.col("wanted"), "left")
    return orders.join(known, F.col("o_orderkey") == F.col("key"), "left").select("o_orderkey", F.coalesce("seen", F.lit(False)).alias("seen"), F.coalesce("in_list", F.lit(False)).alias("in_list"))


QUERIES = {f.__name__: f for f in (
    like_any, plain_like, state_arrays, has_bases, null_gates, json_paths, docx_page, factor_names, paired_lists, column_starts, recent_count, new_types, changes_order, history_order, base_view, detail_view, queues, probes,
)}

_WORDS = [w for w, _ in lookups.FACTORS]
_PICK = lambda c: "CASE " + c + " % 17 " + " ".join(f"WHEN {k} THEN '{w.lower()}x'" for k, w in enumerate(_WORDS)) + " ELSE 'otra cosa' END"
_NEWEST = "(SELECT DISTINCT ON (l_orderkey) l_orderkey, l_linenumber, l_returnflag FROM lineitem ORDER BY l_orderkey, (l_returnflag = 'R') DESC, l_shipdate DESC NULLS LAST, " + _DOCUMENT_SQL + ")"
_KINDS = ("click", "view", "purchase", "error", "signup")
_WARNED = " + ".join(f"CASE WHEN coalesce({k} > 50, false) AND ({'true' if k == 'purchase' else 'false'} OR coalesce(l_returnflag, '') <> 'N') THEN 1 ELSE 0 END" for k in _KINDS)

ORACLE_SQL = {
    "like_any": "SELECT p_partkey, lower(p_type) LIKE 'promo%' OR lower(p_type) LIKE '%steel' AS any_of, NOT (lower(p_type) LIKE '%brass%' OR lower(p_type) LIKE 'small%') AS none_of, p_type ILIKE 'econ%' AS ilike, regexp_matches(p_type, '(?i)an?o[dn]ized') AS regex FROM part",
    "plain_like": "SELECT doc_id, contains(strip_accents(lower(text)), 'etre') AS found FROM documents",
    "state_arrays": """
        SELECT c_custkey, coalesce(count(o_orderkey) > 0 AND NOT bool_or(o_orderstatus = 'F'), false) AS lacks_f, count(o_orderkey) = 0 OR bool_or(o_orderstatus IN ('P', 'O')) AS watched FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""",
    "has_bases": """
        SELECT l_orderkey, bool_or(l_returnflag IN ('R', 'A') AND l_linestatus = 'F') AS has_bases,
          array_to_string(list_sort(list(DISTINCT CASE l_returnflag WHEN 'R' THEN 'Bases Íntegradas' WHEN 'A' THEN 'BÁSES' ELSE 'Acta' END)), ',') AS kinds FROM lineitem GROUP BY 1""",
    "null_gates": """
        SELECT o_orderkey, count(l_orderkey) = 0 AS no_document FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING min(CASE WHEN l_returnflag <> 'N' THEN l_shipdate END) IS NULL""",
    "json_paths": "SELECT event_id, props->>'$.k' AS k, CASE WHEN event_id % 9 > 0 THEN props->>'$.k' END AS within, props->>'$.k' AS answered, [event_type] AS as_array FROM events",
    "docx_page": """
        SELECT strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') || CASE l_returnflag WHEN 'R' THEN '.DOCX' WHEN 'A' THEN '.pdf' END AS file, CASE WHEN l_returnflag <> 'R' AND l_returnflag <> 'N' THEN max(l_linenumber) WHEN l_returnflag = 'N' THEN max(l_linenumber) END::BIGINT AS page
        FROM (SELECT CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_shipdate END AS l_shipdate, l_returnflag, l_linenumber FROM lineitem) GROUP BY l_shipdate, l_returnflag""",
    "factor_names": f"""
        WITH s AS (SELECT p_partkey, upper({_PICK('p_partkey')} || ' ' || {_PICK('p_size')}) AS said FROM part)
        SELECT p_partkey, CASE {' '.join(f"WHEN contains(said, '{w}') THEN '{n}'" for w, n in lookups.FACTORS)} ELSE '{lookups.UNNAMED}' END AS factor FROM s""",
    "paired_lists": """
        WITH l AS (SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber)) AS a, list_sort(list(DISTINCT l_returnflag)) AS b FROM lineitem GROUP BY 1)
        SELECT l_orderkey, array_to_string([x || '=' || b[i] FOR x, i IN a], ',') AS pairs FROM l WHERE len(a) = len(b)""",
    "column_starts": """
        WITH c AS (SELECT l_suppkey, CAST(l_quantity AS INT) AS q, count(*) AS n FROM lineitem GROUP BY 1, 2), t AS (SELECT l_suppkey, max(n) AS top FROM c GROUP BY 1)
        SELECT l_suppkey, CAST(min(q) AS BIGINT) AS start FROM c JOIN t USING (l_suppkey) WHERE n >= least(top, greatest(3, top / 3)) GROUP BY 1""",
    "recent_count": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts)) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS recent FROM events",
    "new_types": """
        WITH f AS (SELECT user_id, event_type, min((epoch_us(ts), event_id)) AS first FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS types FROM f GROUP BY 1""",
    "changes_order": """
        WITH o AS (SELECT *, CASE WHEN o_orderkey % 10 > 0 THEN o_orderdate END AS lim FROM orders)
        SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus <> 'O', lim NULLS LAST, o_orderkey) AS place, row_number() OVER (ORDER BY lim DESC NULLS LAST, o_orderkey DESC) AS newest FROM o""",
    "history_order": """
        SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS newest, row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'view' DESC, event_id) AS stable FROM events""",
    "base_view": f"""
        WITH r AS (SELECT user_id, {', '.join(f"arg_max(value, (epoch_us(ts), event_id)) FILTER (WHERE event_type = '{k}') AS {k}" for k in _KINDS)} FROM events GROUP BY 1)
        SELECT o_orderkey, coalesce(o_orderstatus = 'O' AND o_orderdate + INTERVAL 30 DAY > TIMESTAMP '{NOW}', false) AS is_open, l_linenumber::BIGINT AS document, {', '.join(_KINDS)},
          coalesce(CASE WHEN coalesce(click > 50, false) THEN CAST(click AS DECIMAL(15,2)) END, CAST(o_totalprice AS DECIMAL(15,2))) AS amount, CAST({_WARNED} AS BIGINT) AS n_warnings
        FROM orders LEFT JOIN {_NEWEST} n ON l_orderkey = o_orderkey LEFT JOIN r ON user_id = o_custkey""",
    "detail_view": f"""
        WITH d AS (SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC) AS documents FROM lineitem GROUP BY 1),
        s AS (SELECT user_id, arg_max(event_type, (epoch_us(ts), event_id)) AS last_stage, count(*) AS n FROM events GROUP BY 1)
        SELECT o_orderkey, documents, last_stage, coalesce(n, 0) AS n_history, date_diff('day', DATE '{NOW}', CAST(o_orderdate AS DATE)) AS days_left FROM orders LEFT JOIN d ON l_orderkey = o_orderkey LEFT JOIN s ON user_id = o_custkey""",
    "queues": """
        WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_returnflag, l_linestatus FROM lineitem)
        SELECT CASE WHEN l_linestatus = 'O' THEN 'fetch' WHEN l_returnflag = 'R' THEN 'unpack' WHEN l_returnflag = 'A' THEN 'read' ELSE 'nothing' END AS todo, count(*) AS n, count(DISTINCT l_orderkey) AS n_tenders FROM l GROUP BY 1""",
    "probes": """
        SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49 LIMIT 1) AS seen, o_orderkey < 100 AND o_orderkey % 7 = 0 AS in_list FROM orders""",
}
