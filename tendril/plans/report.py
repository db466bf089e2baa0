"""Reports and listings on the driver's tables: orders stand for tenders, lineitem for documents, events for readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import amounts, dates
from ..functions.text import join_words
from ..operators import filters, grouping, ranking
from ..sources.tables import table

NOW = "2000-01-01"
EVENTS_NOW = "2024-01-31"
#: A full order of documents: (orderkey, linenumber) is not unique.
DOCUMENT_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
_DOCUMENT_SQL = ", ".join(f"{c} DESC" for c in DOCUMENT_ORDER)


def now(day: str = NOW):
    return F.lit(day).cast("timestamp_ntz")


def pending_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenders not reported yet, with state, days left, and how many documents they have and are done."""
    orders, docs = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    counted = docs.groupBy("l_orderkey").agg(F.count("*").alias("n_docs"), F.count(F.when(F.col("l_linestatus") == "F", 1)).alias("n_done"))
    pending = orders.filter("o_orderstatus <> 'P'").join(counted, orders.o_orderkey == counted.l_orderkey, "left")
    limit = F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")
    state = F.when(F.col("o_orderdate").isNull(), "sin fecha límite").when(limit < now(), "plazo vencido").otherwise("abierta")
    left = dates.days_until(limit, now())
    shown = pending.select("o_orderkey", "o_custkey", state.alias("state"), left.alias("days_left"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n_done", F.lit(0)).alias("n_done"))
    return shown


def newest_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "lineitem")
    order = [(F.col("l_returnflag") == "R").desc(), F.col("l_shipdate").desc_nulls_last(), *(F.col(c).desc() for c in DOCUMENT_ORDER)]
    return ranking.newest_per_group(docs, ["l_orderkey"], order).select("l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate")


def newest_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "lineitem").dropDuplicates()
    order = [(F.col("l_returnflag") == "R").desc(), F.col("l_shipdate").desc_nulls_last(), *(F.col(c).desc() for c in DOCUMENT_ORDER)]
    return ranking.newest_flag(docs, ["l_orderkey"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "newest")


def distinct_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return ranking.newest_per_group(orders, ["o_custkey"], [F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey").desc()]).select("o_custkey", "o_orderkey", "o_orderstatus")


def asof_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return ranking.asof_previous(orders, ["o_custkey", "o_orderpriority"], "o_orderkey").filter("previous is not null").select("o_orderkey", "previous")


def asof_restart_excluding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predecessors that an earlier link has taken are passed over: links come from orders of the years before 1998."""
    orders = table(spark, sf_dir, "orders")
    old = ranking.asof_previous(orders.filter("o_orderdate < '1998-01-01'"), ["o_custkey", "o_orderpriority"], "o_orderkey")
    links = old.filter("previous is not null").select(F.col("previous").alias("taken"))
    fresh = ranking.asof_previous_free(orders, links, ["o_custkey", "o_orderpriority"], "o_orderkey")
    return fresh.filter("previous is not null and o_orderdate >= '1998-01-01'").select("o_orderkey", "previous")


def latest_reading_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    kinds = ("click", "view", "purchase", "error", "signup")
    return ranking.latest_values(events, ["user_id"], "event_type", "event_id", F.col("at"), kinds)


def last_value_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    history = events.select("user_id", "event_id", "ts", F.concat_ws(": ", "event_type", "props").alias("text"))
    stages = events.select("user_id", F.col("event_type").alias("stage")).distinct()
    return ranking.last_by_prefix(history, stages, "user_id", "text", "stage", [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "stage", "text")


def open_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.to_date(F.min(F.when(F.col("o_orderstatus") == "O", F.col("o_orderdate")))).alias("since"))


def watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("state", F.when(F.col("o_orderstatus") == "O", "abierta").when(F.col("o_orderstatus") == "P", "parada").otherwise("cerrada"))
    return orders.filter(filters.watched(F.col("state"), F.col("o_orderdate"), now())).select("o_orderkey", "state")


def mark_stalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open tenders whose latest sign of life, of several clocks, is over 60 days old."""
    orders, docs = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    shipped = docs.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last_doc"))
    both = orders.filter("o_orderstatus = 'O'").join(shipped, orders.o_orderkey == shipped.l_orderkey, "left")
    seen = both.select("o_orderkey", F.greatest("o_orderdate", "last_doc").alias("last_seen"))
    return seen.filter(F.col("last_seen") < now() - F.expr("INTERVAL 60 DAYS"))


def semi_followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    followed = table(spark, sf_dir, "events").filter("event_type = 'signup'").select(F.col("user_id").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(followed, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


def anti_unread(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(read, "o_orderkey", "left_anti").select("o_orderkey", "o_orderstatus")


def exists_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(1).alias("one")).distinct()
    return table(spark, sf_dir, "orders").join(returned, "o_orderkey", "left").select("o_orderkey", F.col("one").isNotNull().alias("has_returned"))


def array_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    gathered = turns.groupBy("conv_id").agg(grouping.collected(["turn"], "role").alias("turns"))
    return gathered.select("conv_id", F.array_join(F.transform("turns", lambda t: t["role"]), ",").alias("roles"))


def changes_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").filter("event_type in ('error', 'signup')")
    gathered = events.groupBy("user_id").agg(grouping.collected(["event_id"], "event_type").alias("changes"), F.count("*").alias("n"))
    return gathered.select("user_id", "n", F.array_join(F.transform("changes", lambda c: F.concat_ws(":", c["event_id"], c["event_type"])), " ").alias("changes"))


def change_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    gathered = events.groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("fields"))
    return gathered.select("user_id", grouping.change_group(F.col("user_id") % 10 == 0, F.col("fields"), ("signup",)).alias("group_name"))


def facet_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    arrays = regions.groupBy("n_nationkey").agg(F.array(F.first("r_name"), F.concat(F.lit("N-"), F.first("n_name"))).alias("places"))
    return grouping.sorted_facet(arrays, "places")


def three_valued_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against filters of which one is about what a reading says: without a reading the row is not lost."""
    orders = table(spark, sf_dir, "orders")
    readings = table(spark, sf_dir, "events").filter("event_type = 'purchase'").groupBy("user_id").agg(F.max("value").alias("experience"))
    base = orders.join(readings, orders.o_custkey == readings.user_id, "left").select("o_orderkey", (F.col("o_orderstatus") == "O").alias("is_open"), F.col("o_totalprice").cast(amounts.MONEY).alias("amount"), F.col("experience").cast(amounts.MONEY).alias("experience"))
    asked = filters.Filters(least="50000", most="250000", most_experience="90")
    return filters.listing(base, asked, now()).select("o_orderkey", "verdict")


def listing_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    people = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    placed = orders.join(people, orders.o_custkey == people.c_custkey).select("o_orderkey", F.array("r_name").alias("regions"), (F.col("o_orderstatus") == "O").alias("is_open"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("limit"), F.col("o_orderdate").alias("published"), F.col("o_totalprice").cast(amounts.MONEY).alias("amount"))
    asked = filters.Filters(regions=("ASIA", "EUROPE"), closing=30, published=30, least="1000")
    return filters.listing(placed, asked, now()).filter("verdict = 'si'").select("o_orderkey", dates.days_until(F.col("limit"), now()).alias("days_left"))


def listing_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open first by closeness, then closed by latest limit; the order is shown as a number."""
    orders = table(spark, sf_dir, "orders").withColumn("is_open", F.when(F.col("o_orderstatus") == "P", F.lit(None)).otherwise(F.col("o_orderstatus") == "O"))
    order = [F.col("is_open").desc_nulls_last(), F.when(F.col("is_open"), F.col("o_orderdate")).asc_nulls_last(), F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey").asc()]
    day = F.unix_date(F.to_date("o_orderdate"))
    steps = [F.when(F.col("is_open"), 0).when(~F.col("is_open"), 1), F.when(F.col("is_open"), day), -day]
    return ranking.global_place(orders, steps, order).select("o_orderkey", F.col("place").cast("long").alias("place"))


def amount_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest amount first; zero counts as missing and comes last."""
    parts = table(spark, sf_dir, "customer").withColumn("amount", F.greatest(F.lit(0.0), F.col("c_acctbal")))
    order = [F.nullif(F.col("amount"), F.lit(0.0)).desc_nulls_last(), F.col("c_custkey").asc()]
    some, none = F.when(F.col("amount") > 0, -F.col("amount")), F.when(F.col("amount") == 0, F.col("c_custkey"))
    steps = [ranking.quantile_step(parts, some), ranking.quantile_step(parts, none)]
    return ranking.global_place(parts, steps, order, ["c_mktsegment"]).select("c_mktsegment", "c_custkey", F.col("place").cast("long").alias("place"))


def topk_with_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    top = ranking.top_with_rest(orders, ["o_orderpriority"], [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()], 10)
    return top.select("o_orderpriority", F.col("place").cast("long").alias("place"), "o_orderkey", F.col("more").cast("long").alias("more"))


def budget_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("cost", F.col("o_totalprice").cast("decimal(15,2)")).withColumn("month", dates.month_start(F.col("o_orderdate")))
    kept = ranking.within_budget(orders, ["month"], [F.col("o_orderdate").asc(), F.col("o_orderkey").asc()], F.col("cost"), F.lit(5_000_000).cast("decimal(15,2)"))
    return kept.select("month", "o_orderkey", F.col("spent").cast("decimal(18,2)").alias("spent"))


def closing_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = dates.days_until(F.col("o_orderdate"), F.lit("1999-12-30").cast("timestamp_ntz"))
    near = table(spark, sf_dir, "orders").withColumn("days", days)
    return near.groupBy(dates.closing_bucket(F.col("days")).alias("bucket")).agg(F.count("*").alias("n"))


def state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    is_ = lambda s: F.col("o_orderstatus") == s
    return orders.groupBy("o_orderpriority").agg(F.count(F.when(is_("O"), 1)).alias("n_open"), F.count(F.when(~is_("O"), 1)).alias("n_other"), F.count_distinct("o_custkey").alias("n_customers"))


def csv_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", dates.csv_instant(F.col("o_orderdate")).alias("published"), amounts.csv_amount(F.nullif(F.col("o_totalprice").cast("decimal(15,2)"), F.lit(0).cast("decimal(15,2)"))).alias("amount"))


def derived_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amount with fallback, days left and labels of each order with the newest document."""
    newest = newest_document(spark, sf_dir)
    orders = table(spark, sf_dir, "orders")
    joined = orders.join(newest, orders.o_orderkey == newest.l_orderkey, "left")
    read = F.when(F.col("l_returnflag") == "N", F.lit("")).otherwise(F.col("l_linenumber").cast("string"))
    return joined.select("o_orderkey", amounts.coalesce_amount(read, F.col("o_totalprice")).alias("amount"), F.col("l_returnflag").isNotNull().alias("has_document"), join_words(F.array("o_orderstatus", "o_orderpriority")).alias("label"))


QUERIES = {f.__name__: f for f in (
    pending_report, newest_document, newest_flag, distinct_on, asof_restart, asof_restart_excluding, latest_reading_pivot, last_value_by_prefix, open_since, watched, mark_stalled, semi_followed, anti_unread, exists_documents, array_children,
    changes_grouped, change_groups, facet_values, three_valued_listing, listing_filters, listing_order, amount_order, topk_with_rest, budget_cutoff, closing_buckets, state_counts, csv_projection, derived_rows,
)}

ORACLE_SQL = {
    "pending_report": """
        SELECT o_orderkey, o_custkey,
          CASE WHEN o_orderdate IS NULL THEN 'sin fecha límite' WHEN o_orderdate + INTERVAL 30 DAY < TIMESTAMP '2000-01-01' THEN 'plazo vencido' ELSE 'abierta' END AS state,
          date_diff('day', DATE '2000-01-01', CAST(o_orderdate + INTERVAL 30 DAY AS DATE)) AS days_left,
          count(l_orderkey) AS n_docs, count(*) FILTER (WHERE l_linestatus = 'F') AS n_done
        FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' GROUP BY ALL""",
    "newest_document": f"""
        SELECT DISTINCT ON (l_orderkey) l_orderkey, l_linenumber, l_returnflag, l_shipdate FROM lineitem
        ORDER BY l_orderkey, (l_returnflag = 'R') DESC, l_shipdate DESC NULLS LAST, {_DOCUMENT_SQL}""",
    "newest_flag": f"""
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_returnflag = 'R') DESC, l_shipdate DESC NULLS LAST, {_DOCUMENT_SQL}) = 1 AS newest
        FROM (SELECT DISTINCT * FROM lineitem)""",
    "distinct_on": "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderstatus FROM orders ORDER BY o_custkey, o_orderdate DESC NULLS LAST, o_orderkey DESC",
    "asof_restart": "SELECT a.o_orderkey, max(b.o_orderkey) AS previous FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority AND b.o_orderkey < a.o_orderkey GROUP BY 1",
    "asof_restart_excluding": """
        WITH old AS (SELECT * FROM orders WHERE o_orderdate < '1998-01-01'),
        links AS (SELECT a.o_orderkey, max(b.o_orderkey) AS taken FROM old a JOIN old b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority AND b.o_orderkey < a.o_orderkey GROUP BY 1)
        SELECT a.o_orderkey, max(b.o_orderkey) AS previous FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority AND b.o_orderkey < a.o_orderkey
        WHERE a.o_orderdate >= '1998-01-01' AND NOT EXISTS (SELECT 1 FROM links WHERE taken = b.o_orderkey) GROUP BY 1""",
    "latest_reading_pivot": "SELECT user_id, " + ", ".join(f"(arg_max(event_id, (ts, event_id)) FILTER (WHERE event_type = '{k}')) AS {k}" for k in ("click", "view", "purchase", "error", "signup")) + " FROM events GROUP BY 1",
    "last_value_by_prefix": "SELECT user_id, event_type AS stage, event_type || ': ' || props AS text FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "open_since": "SELECT o_orderpriority, CAST(min(o_orderdate) FILTER (WHERE o_orderstatus = 'O') AS DATE) AS since FROM orders GROUP BY 1",
    "watched": """
        SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'abierta' ELSE 'parada' END AS state FROM orders
        WHERE o_orderstatus = 'O' OR o_orderstatus = 'P' AND o_orderdate >= TIMESTAMP '2000-01-01' - INTERVAL 180 DAY""",
    "mark_stalled": """
        SELECT o_orderkey, greatest(o_orderdate, last_doc) AS last_seen FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS last_doc FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
        WHERE o_orderstatus = 'O' AND greatest(o_orderdate, last_doc) < TIMESTAMP '2000-01-01' - INTERVAL 60 DAY""",
    "semi_followed": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT user_id FROM events WHERE event_type = 'signup')",
    "anti_unread": "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "exists_documents": "SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS has_returned FROM orders",
    "array_children": "SELECT conv_id, string_agg(role, ',' ORDER BY turn, role) AS roles FROM conversations GROUP BY 1",
    "changes_grouped": "SELECT user_id, count(*) AS n, string_agg(event_id || ':' || event_type, ' ' ORDER BY event_id, event_type) AS changes FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1",
    "change_groups": "SELECT user_id, CASE WHEN user_id % 10 = 0 THEN 'followed' WHEN bool_or(event_type = 'signup') THEN 'dates' ELSE 'other' END AS group_name FROM events GROUP BY 1",
    "facet_values": "SELECT DISTINCT value FROM (SELECT r_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'N-' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey)",
    "three_valued_listing": """
        SELECT o_orderkey, CASE WHEN experience IS NULL THEN 'sin_leer' ELSE 'si' END AS verdict
        FROM orders LEFT JOIN (SELECT user_id, CAST(max(value) AS DECIMAL(15,2)) AS experience FROM events WHERE event_type = 'purchase' GROUP BY 1) ON user_id = o_custkey
        WHERE o_orderstatus = 'O' AND CAST(o_totalprice AS DECIMAL(15,2)) BETWEEN 50000 AND 250000 AND (experience IS NULL OR experience <= 90)""",
    "listing_filters": """
        SELECT o_orderkey, date_diff('day', DATE '2000-01-01', CAST(o_orderdate + INTERVAL 30 DAY AS DATE)) AS days_left
        FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
        WHERE r_name IN ('ASIA', 'EUROPE') AND o_orderstatus = 'O' AND date_diff('day', DATE '2000-01-01', CAST(o_orderdate + INTERVAL 30 DAY AS DATE)) <= 30
          AND date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') <= 30 AND CAST(o_totalprice AS DECIMAL(15,2)) >= 1000""",
    "listing_order": """
        SELECT o_orderkey, row_number() OVER (ORDER BY is_open DESC NULLS LAST, CASE WHEN is_open THEN o_orderdate END NULLS LAST, o_orderdate DESC NULLS LAST, o_orderkey) AS place
        FROM (SELECT *, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus = 'O' END AS is_open FROM orders)""",
    "amount_order": """
        SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY nullif(greatest(0.0, c_acctbal), 0.0) DESC NULLS LAST, c_custkey) AS place FROM customer""",
    "topk_with_rest": """
        SELECT o_orderpriority, place, o_orderkey, greatest(n - 10, 0) AS more
        FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) WHERE place <= 10""",
    "budget_cutoff": """
        SELECT month, o_orderkey, CAST(spent AS DECIMAL(18,2)) AS spent FROM (
          SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderkey,
            coalesce(sum(CAST(o_totalprice AS DECIMAL(15,2))) OVER (PARTITION BY date_trunc('month', o_orderdate) ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM orders)
        WHERE spent < 5000000""",
    "closing_buckets": """
        SELECT CASE WHEN days <= 0 THEN 'hoy' WHEN days = 1 THEN 'manana' WHEN days < 7 THEN 'semana' ELSE 'despues' END AS bucket, count(*) AS n
        FROM (SELECT date_diff('day', DATE '1999-12-30', CAST(o_orderdate AS DATE)) AS days FROM orders) GROUP BY 1""",
    "state_counts": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open, count(*) FILTER (WHERE o_orderstatus <> 'O') AS n_other, count(DISTINCT o_custkey) AS n_customers FROM orders GROUP BY 1",
    "csv_projection": """
        SELECT o_orderkey, strftime(o_orderdate - INTERVAL 5 HOUR, '%d/%m/%Y %H:%M') AS published, replace(CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR), '.', ',') AS amount FROM orders""",
    "derived_rows": f"""
        WITH newest AS (SELECT DISTINCT ON (l_orderkey) * FROM lineitem ORDER BY l_orderkey, (l_returnflag = 'R') DESC, l_shipdate DESC NULLS LAST, {_DOCUMENT_SQL})
        SELECT o_orderkey, coalesce(CAST(CASE WHEN l_returnflag <> 'N' THEN l_linenumber END AS DECIMAL(15,2)), CAST(o_totalprice AS DECIMAL(15,2))) AS amount, l_orderkey IS NOT NULL AS has_document, o_orderstatus || ' y ' || o_orderpriority AS label
        FROM orders LEFT JOIN newest ON l_orderkey = o_orderkey""",
}
