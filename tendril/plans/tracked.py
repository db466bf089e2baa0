"""Tracked state on the driver's tables: orders and events, cut by time into what is stored and what comes in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranking, state
from ..sources.ranges import leaves
from ..sources.tables import table

CUT = "2000-01-01"


def _order(*, last: bool) -> list:
    return [F.desc("o_orderdate"), F.desc("o_orderkey")] if last else [F.asc("o_orderdate"), F.asc("o_orderkey")]


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored: the newest order before the cut of two thirds of the customers. New: the orders after it."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    old = ranking.newest_per_group(orders.filter((F.col("o_orderdate") < CUT) & (F.col("o_custkey") % 3 > 0)), ["o_custkey"], _order(last=True))
    return old, orders.filter(F.col("o_orderdate") >= CUT)


def insert_if_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _stored(spark, sf_dir)
    return state.insert_if_new(old, new, ["o_custkey"], _order(last=False))


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _stored(spark, sf_dir)
    return state.upsert_latest(old, new, ["o_custkey"], _order(last=True))


def upsert_if_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _stored(spark, sf_dir)
    first = ranking.newest_per_group(new, ["o_custkey"], _order(last=False))
    return state.upsert_if_changed(old, first, ["o_custkey"], "o_orderstatus")


def upsert_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.to_date(F.date_trunc("year", "o_orderdate")).alias("month"), F.col("o_totalprice").cast("decimal(15,2)").alias("usd"), F.lit(1).cast("long").alias("pages"), "o_custkey")
    summed = state.add_up(orders.filter("o_custkey % 2 = 0"), orders.filter("o_custkey % 2 = 1"), ["month"], ["usd", "pages"])
    return summed.select("month", F.col("usd").cast("decimal(25,2)").alias("usd"), "pages")


def replace_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus")
    return state.replace_group(lines.filter("l_linestatus = 'O'"), lines.filter("l_linestatus = 'F' and l_orderkey % 5 = 0"), ["l_orderkey"])


def previous_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _stored(spark, sf_dir)
    first = ranking.newest_per_group(new, ["o_custkey"], _order(last=False))
    return state.with_previous(old, first, ["o_custkey"], "o_orderstatus", "before").select("o_custkey", "o_orderkey", "before")


def _readings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two readings of each order: its lines of odd and of even number, the shipping date missing where it was returned."""
    lines = table(spark, sf_dir, "lineitem")
    reading = lambda odd: lines.filter(F.col("l_linenumber") % 2 == odd).groupBy("l_orderkey").agg(F.max("l_returnflag").alias("flag"), F.max(F.when(F.col("l_returnflag") != "R", F.to_date("l_shipdate"))).alias("shipped"), F.count("*").alias("n"))
    return reading(1), reading(0)


def field_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _readings(spark, sf_dir)
    return state.field_changes(old, new, ["l_orderkey"], ["flag", "shipped", "n"], keep_old_on_null=["shipped"])


def keyed_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages (line numbers) of odd orders against the next even ones."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("flag"), F.min("l_quantity").alias("quantity"))
    old = lines.filter("l_orderkey % 2 = 1").withColumn("pair", F.expr("(l_orderkey - 1) div 2")).withColumn("at", F.col("l_linenumber"))
    new = lines.filter("l_orderkey % 2 = 0").withColumn("pair", F.expr("l_orderkey div 2")).withColumn("at", F.col("l_linenumber"))
    found = state.keyed_differences(old, new, ["pair", "l_linenumber"], ["flag"], "at")
    return found.select("pair", "l_linenumber", "kind", F.col("before.flag").alias("before"), F.col("after.flag").alias("after"), F.col("place.is_new").alias("is_new"))


def retry_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").filter("event_type in ('error', 'purchase')")
    return state.retry_state(events, ["user_id"], F.col("event_type") == "purchase", [F.asc("ts"), F.asc("event_id")])


def lifecycle_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    named = F.when((F.col("event_type") == "signup") & (F.col("value") > 99), "close").when((F.col("event_type") == "error") & (F.col("value") > 99), "restart").when(F.col("event_type") == "view", "idle").otherwise("change")
    return state.lifecycle(events.withColumn("what", named), ["user_id"], "what", [F.asc("ts"), F.asc("event_id")])


def documents_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share an id, or without one all names, are one."""
    lines = table(spark, sf_dir, "lineitem").withColumn("uuid", F.when(F.col("l_returnflag") != "N", F.col("l_partkey").cast("string")))
    keyed = lines.withColumn("doc_key", state.document_key(F.col("uuid"), F.col("l_returnflag"), F.col("l_linestatus")))
    return keyed.groupBy("l_orderkey").agg(F.count_distinct("doc_key").alias("n_documents"))


def range_split_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of days halved until each holds no more orders than a search can show."""
    days = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return leaves(days, "day", "n", 100)


def sum_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.grouping import sum_check as check

    lines = table(spark, sf_dir, "lineitem").withColumn("units", F.col("l_quantity").cast("long")).withColumn("stated", F.col("l_orderkey") % 100)
    return check(lines, ["l_orderkey"], "units", F.col("stated"), F.lit(100).cast("long"))


def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return ranking.islands(lines, ["l_orderkey"], "l_linenumber").select("l_orderkey", F.col("first").cast("long").alias("first_page"), F.col("last").cast("long").alias("last_page"))


def two_readings_differ(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.grouping import differing

    old, new = _readings(spark, sf_dir)
    both = old.select("l_orderkey", F.struct("flag", "shipped", "n").alias("a")).join(new.select("l_orderkey", F.struct("flag", "shipped", "n").alias("b")), "l_orderkey")
    return both.select("l_orderkey", F.array_join(differing(F.col("a"), F.col("b"), ["flag", "shipped", "n"]), ",").alias("fields"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those pending and those tracked, each once."""
    orders = table(spark, sf_dir, "orders")
    return orders.filter("o_orderstatus = 'O'").select("o_custkey").union(orders.filter("o_totalprice > 200000").select("o_custkey")).distinct()


def unread_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set difference of keys: customers without an order that was read whole (finished)."""
    read = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("custkey")).distinct()
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey")).exceptAll(read)


QUERIES = {f.__name__: f for f in (
    insert_if_new, upsert_latest, upsert_if_changed, upsert_additive, replace_group, previous_value, field_changes, keyed_differences, retry_fold, lifecycle_fold, documents_two_keys, range_split_leaves, sum_check, page_ranges, two_readings_differ, candidates, unread_customers,
)}

_OLD = "(SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderstatus, o_orderdate FROM orders WHERE o_orderdate < '2000-01-01' AND o_custkey % 3 > 0 ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC)"
_NEW = "(SELECT o_custkey, o_orderkey, o_orderstatus, o_orderdate FROM orders WHERE o_orderdate >= '2000-01-01')"
_FIRST = f"(SELECT DISTINCT ON (o_custkey) * FROM {_NEW} ORDER BY o_custkey, o_orderdate, o_orderkey)"
_READING = "(SELECT l_orderkey, max(l_returnflag) AS flag, CAST(max(CASE WHEN l_returnflag <> 'R' THEN l_shipdate END) AS DATE) AS shipped, count(*) AS n FROM lineitem WHERE l_linenumber % 2 = {odd} GROUP BY 1)"
_BOTH = f"SELECT a.l_orderkey, a.flag AS flag_a, b.flag AS flag_b, a.shipped AS shipped_a, b.shipped AS shipped_b, a.n AS n_a, b.n AS n_b FROM {_READING.format(odd=1)} a JOIN {_READING.format(odd=0)} b USING (l_orderkey)"
_STAGES = "SELECT l_orderkey, l_linenumber, max(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2"

ORACLE_SQL = {
    "insert_if_new": f"SELECT * FROM {_OLD} UNION ALL SELECT * FROM {_FIRST} WHERE o_custkey NOT IN (SELECT o_custkey FROM {_OLD})",
    "upsert_latest": f"SELECT DISTINCT ON (o_custkey) * FROM (SELECT * FROM {_OLD} UNION ALL SELECT * FROM {_NEW}) ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC",
    "upsert_if_changed": f"""
        WITH old AS {_OLD}, new AS {_FIRST}, changed AS (SELECT new.* FROM new LEFT JOIN old USING (o_custkey) WHERE old.o_custkey IS NULL OR old.o_orderstatus IS DISTINCT FROM new.o_orderstatus)
        SELECT * FROM changed UNION ALL SELECT * FROM old WHERE o_custkey NOT IN (SELECT o_custkey FROM changed)""",
    "upsert_additive": "SELECT CAST(date_trunc('year', o_orderdate) AS DATE) AS month, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DECIMAL(25,2)) AS usd, count(*) AS pages FROM orders GROUP BY 1",
    "replace_group": """
        WITH new AS (SELECT l_orderkey, l_linenumber, l_partkey, l_linestatus FROM lineitem WHERE l_linestatus = 'F' AND l_orderkey % 5 = 0)
        SELECT * FROM new UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_linestatus FROM lineitem WHERE l_linestatus = 'O' AND l_orderkey NOT IN (SELECT l_orderkey FROM new)""",
    "previous_value": f"SELECT n.o_custkey, n.o_orderkey, o.o_orderstatus AS before FROM {_FIRST} n LEFT JOIN {_OLD} o USING (o_custkey)",
    "field_changes": f"""
        WITH b AS ({_BOTH})
        SELECT l_orderkey, 'flag' AS field, flag_a AS before, flag_b AS after FROM b WHERE flag_a IS DISTINCT FROM flag_b
        UNION ALL SELECT l_orderkey, 'shipped', CAST(shipped_a AS VARCHAR), CAST(shipped_b AS VARCHAR) FROM b WHERE shipped_b IS NOT NULL AND shipped_a IS DISTINCT FROM shipped_b
        UNION ALL SELECT l_orderkey, 'n', CAST(n_a AS VARCHAR), CAST(n_b AS VARCHAR) FROM b WHERE n_a IS DISTINCT FROM n_b""",
    "keyed_differences": f"""
        WITH s AS ({_STAGES}), a AS (SELECT (l_orderkey - 1) // 2 AS pair, l_linenumber, flag FROM s WHERE l_orderkey % 2 = 1), b AS (SELECT l_orderkey // 2 AS pair, l_linenumber, flag FROM s WHERE l_orderkey % 2 = 0)
        SELECT pair, l_linenumber, CASE WHEN a.flag IS NULL THEN 'new' WHEN b.flag IS NULL THEN 'gone' ELSE 'moved' END AS kind, a.flag AS before, b.flag AS after, a.flag IS NULL AS is_new
        FROM a FULL JOIN b USING (pair, l_linenumber) WHERE a.flag IS DISTINCT FROM b.flag""",
    "retry_fold": """
        WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type IN ('error', 'purchase')),
        f AS (SELECT user_id, max(i) - coalesce(max(i) FILTER (WHERE event_type = 'purchase'), 0) AS attempts FROM e GROUP BY 1)
        SELECT user_id, attempts, CASE WHEN attempts = 0 THEN 'done' WHEN attempts >= 3 THEN 'error' ELSE 'pending' END AS state FROM f""",
    "lifecycle_fold": """
        WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i,
            CASE WHEN event_type = 'signup' AND value > 99 THEN 'close' WHEN event_type = 'error' AND value > 99 THEN 'restart' WHEN event_type = 'view' THEN 'idle' ELSE 'change' END AS what
          FROM events),
        f AS (SELECT user_id, arg_min(what, i) FILTER (WHERE what IN ('close', 'restart')) AS ended, arg_max(what, i) FILTER (WHERE what IN ('idle', 'change')) AS moved FROM e GROUP BY 1)
        SELECT user_id, CASE WHEN ended = 'close' THEN 'cerrada' WHEN ended = 'restart' THEN 'reiniciada' WHEN moved = 'idle' THEN 'parada' ELSE 'abierta' END AS state FROM f""",
    "documents_two_keys": "SELECT l_orderkey, count(DISTINCT CASE WHEN l_returnflag <> 'N' THEN CAST(l_partkey AS VARCHAR) ELSE '~' || l_returnflag || chr(31) || l_linestatus END) AS n_documents FROM lineitem GROUP BY 1",
    "range_split_leaves": """
        WITH RECURSIVE days AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1),
        r AS (
          SELECT min(day) AS first_day, max(day) AS last_day, CAST(sum(n) AS BIGINT) AS n FROM days
          UNION ALL
          SELECT h.a, h.b, coalesce((SELECT CAST(sum(n) AS BIGINT) FROM days WHERE day BETWEEN h.a AND h.b), 0)
          FROM (SELECT unnest([first_day, CAST(first_day + CAST((last_day - first_day) // 2 AS INT) + 1 AS DATE)]) AS a, unnest([CAST(first_day + CAST((last_day - first_day) // 2 AS INT) AS DATE), last_day]) AS b FROM r WHERE n >= 100 AND first_day < last_day) h
        )
        SELECT first_day, last_day, n FROM r WHERE n < 100 OR first_day = last_day""",
    "sum_check": """
        SELECT l_orderkey, parts, total, parts = total AS matches_total, parts = 100 AS matches_goal
        FROM (SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS parts, l_orderkey % 100 AS total FROM lineitem GROUP BY 1)""",
    "page_ranges": """
        SELECT l_orderkey, CAST(min(l_linenumber) AS BIGINT) AS first_page, CAST(max(l_linenumber) AS BIGINT) AS last_page
        FROM (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS run FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) GROUP BY l_orderkey, run""",
    "two_readings_differ": f"WITH b AS ({_BOTH}) SELECT l_orderkey, concat_ws(',', CASE WHEN flag_a <> flag_b THEN 'flag' END, CASE WHEN shipped_a <> shipped_b THEN 'shipped' END, CASE WHEN n_a <> n_b THEN 'n' END) AS fields FROM b",
    "candidates": "SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' UNION SELECT o_custkey FROM orders WHERE o_totalprice > 200000",
    "unread_customers": "SELECT c_custkey AS custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'",
}
