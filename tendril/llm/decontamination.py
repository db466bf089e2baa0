"""Benchmark decontamination: which words of a document lie inside an item-sized window of a benchmark item.

A window is WINDOW consecutive words of an item, or the whole item where it has fewer. As a set join: a window is the set of
its shingles (SHINGLE words each), and it must be contained whole in a document. With containment of 1 the prefix of a
window in any global order of shingles is its first one, so that one has to be met. The order is by rarity: how often each
shingle of the benchmark occurs in all documents (`shingle_counts`, a map-side count). A window with a shingle that occurs
nowhere goes; the others join by their rarest shingle alone. A meeting at word p with a shingle at offset o fixes the
window's place, p - o; it must lie inside the document (positional and length bounds), and then the words of the place are
compared with those of the window. Hashes pick candidates only; what counts is exact.

Everything is DataFrame functions. The prefix table is broadcast if its bytes, summed before, are few; beyond that slim rows
(document, place, hash) are shuffled, with hot shingles (whose counts are known) dealt over tasks, and the candidates meet
the words again by document.

Defined cases: a null or empty text has no words, no hit and no item; a null item has no window; items that are the same
are all reported; a null item_id is reported as the empty string, items of the same id once; rows of documents that repeat
are reported each; an empty benchmark hits nothing; columns other than doc_id, text and item_id are not read; texts are
read whole, however long.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import hot_keys, spread_join, stored

WINDOW, SHINGLE = 10, 5
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` with A-Z in lower case."""
    text = F.coalesce(text, F.lit(""))
    lowered = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, ascii_uppercase, ascii_lowercase)).otherwise(F.lower(text))
    return F.array_remove(F.split(lowered, BETWEEN), "")


# --- the benchmark ------------------------------------------------------------------------------------------------


def item_windows(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored distinct windows (window_id, window, size), and stored (window_id, item) pairs."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(WINDOW))
    each = items.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - size + 1), lambda i: F.slice("words", i, size))).alias("window")).distinct()
    each = stored(each, "item-windows")
    windows = stored(each.select("window").distinct().select(F.monotonically_increasing_id().alias("window_id"), "window", F.size("window").alias("size")), "windows")
    return windows, stored(each.join(windows, "window").select("window_id", "item"), "window-items")


def shingles(windows: DataFrame) -> DataFrame:
    """(window_id, at, hash): the shingles of each window by offset."""
    width = F.least(F.col("size"), F.lit(SHINGLE))
    placed = windows.select("window_id", "window", width.alias("width"), F.explode(F.sequence(F.lit(0), F.col("size") - width)).alias("at"))
    return placed.select("window_id", "at", F.xxhash64(F.slice("window", F.col("at") + 1, F.col("width"))).alias("hash"))


def _bytes(windows: DataFrame) -> int:
    return windows.agg(F.sum(64 + 16 * F.size("window") + F.octet_length(F.concat_ws("", "window")))).first()[0] or 0


# --- the documents ------------------------------------------------------------------------------------------------


def documents(docs: DataFrame) -> DataFrame:
    """(doc_id, version, words, n): a document is its id and the hash of its text; rows equal in both have equal results."""
    own = docs.select("doc_id", F.xxhash64("text").alias("version"), words(F.col("text")).alias("words"))
    return own.select("*", F.size("words").alias("n"))


def places(own: DataFrame, widths: list[int]) -> DataFrame:
    """own with a row for each place p and width: the hash of the shingle there; one more row of p = -1 stands for the document."""
    at = own.select("*", F.explode(F.sequence(F.lit(-1), F.col("n") - 1)).alias("p"))
    hashed = [F.when((F.col("p") >= 0) & (F.col("p") + w <= F.col("n")), F.xxhash64(F.slice("words", F.greatest("p", F.lit(0)) + 1, w))) for w in widths]
    if len(hashed) == 1:
        return at.select("*", hashed[0].alias("hash"))
    return at.select("*", F.explode(F.when(F.col("p") < 0, F.array(F.lit(None).cast("long"))).otherwise(F.array(*hashed))).alias("hash"))


def shingle_counts(own: DataFrame, known: DataFrame, widths: list[int], small: bool) -> DataFrame:
    """(hash, n): how often each known shingle occurs in all documents."""
    met = places(own, widths).filter("hash is not null").select("hash")
    if small:
        return met.join(F.broadcast(known), "hash").groupBy("hash").agg(F.count("*").alias("n"))
    return met.groupBy("hash").agg(F.count("*").alias("n")).join(known, "hash")


def prefixes(windows: DataFrame, parts: DataFrame, counts: DataFrame) -> DataFrame:
    """(window_id, window, size, hash, at): the rarest shingle of each window that can occur at all."""
    known = parts.join(counts, "hash", "left").select("window_id", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "hash", "at").alias("shingle"))
    rarest = known.groupBy("window_id").agg(F.min("shingle").alias("first")).filter("first.n > 0")
    return windows.join(rarest.select("window_id", "first.hash", "first.at"), "window_id")


def occurrences(own: DataFrame, prefix: DataFrame, counts: DataFrame, widths: list[int], small: bool) -> DataFrame:
    """(doc_id, version, n, copies, spans, windows): each document with the spans (start, end) and ids of the windows in it."""
    start = (F.col("p") - F.col("at")).alias("start")
    fits = (F.col("p") >= F.col("at")) & (F.col("p") - F.col("at") + F.col("size") <= F.col("n"))
    same = F.slice("words", F.greatest(F.col("p") - F.col("at"), F.lit(0)) + 1, F.col("size")) == F.col("window")
    if small:
        met = places(own, widths).join(F.broadcast(prefix), "hash", "left").filter((F.col("p") < 0) | (fits & same))
        met = met.select("doc_id", "version", "n", "p", start, "size", "window_id")
    else:
        slim = places(own, widths).filter("p < 0 or hash is not null").select("doc_id", "version", "n", "p", "hash")
        candidates = spread_join(slim.filter("p >= 0"), prefix.select("hash", "at", "size", "window_id"), ["hash"], hot_keys(counts, ["hash"]), "p").filter(fits)
        candidates = candidates.select("doc_id", "version", F.struct(start, "window_id").alias("c")).groupBy("doc_id", "version").agg(F.collect_set("c").alias("candidates"))
        seen = own.withColumnsRenamed({"doc_id": "_id", "version": "_version"}).join(candidates, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_version") == F.col("version")))
        seen = seen.select("doc_id", "version", "n", "words", F.explode("candidates").alias("c")).select("doc_id", "version", "n", F.slice("words", F.col("c.start") + 1, WINDOW).alias("words"), "c.start", "c.window_id")
        per_window = seen.groupBy("window_id").agg(F.count("*").alias("n"))
        whole = spread_join(seen.withColumn("by", F.xxhash64("doc_id", "version", "start")), prefix.select("window_id", "window", "size"), ["window_id"], hot_keys(per_window, ["window_id"]), "by")
        sure = whole.filter(F.slice("words", F.lit(1), F.col("size")) == F.col("window")).select("doc_id", "version", "n", F.col("start").alias("p"), "start", "size", "window_id")
        met = sure.unionByName(slim.filter("p < 0").select("doc_id", "version", "n", "p"), allowMissingColumns=True)
    inside = lambda what: F.when(F.col("p") >= 0, what)
    return met.groupBy("doc_id", "version").agg(
        F.max("n").alias("n"),
        F.sum((F.col("p") < 0).cast("long")).alias("copies"),
        F.collect_set(inside(F.struct("start", (F.col("start") + F.col("size")).alias("end")))).alias("spans"),
        F.collect_set(inside(F.col("window_id"))).alias("windows"),
    )


def covered(spans: Column) -> Column:
    """Number of words inside any of the spans."""
    step = lambda acc, s: F.struct(F.greatest(acc["reach"], s["end"]).alias("reach"), (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["reach"], s["start"]))).alias("n"))
    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).alias("reach"), F.lit(0).alias("n")), step)["n"]


def scan(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (their ids, sorted as strings) and contaminated of every row of docs."""
    windows, pairs = item_windows(benchmark)
    widths = [r[0] for r in windows.select(F.least("size", F.lit(SHINGLE))).distinct().collect()] or [SHINGLE]
    small = _bytes(windows) * SHINGLE <= common.BROADCAST_BYTES
    own, parts = documents(docs), shingles(windows)
    counts = stored(shingle_counts(own, parts.select("hash").distinct(), widths, small), "shingle-counts")
    prefix = stored(prefixes(windows, parts, counts), "prefixes")
    found = occurrences(own, prefix, counts, widths, small)

    each = found.select("doc_id", "version", "n", "copies", covered(F.col("spans")).alias("n_hit"), F.explode_outer("windows").alias("window_id"))
    if (pairs.agg(F.sum(32 + F.octet_length("item"))).first()[0] or 0) <= common.BROADCAST_BYTES:
        named = each.join(F.broadcast(pairs), "window_id", "left")
    else:
        hot = hot_keys(each.filter("window_id is not null").groupBy("window_id").agg(F.count("*").alias("n")), ["window_id"])
        named = spread_join(each.withColumn("by", F.xxhash64("doc_id", "version")), pairs, ["window_id"], hot, "by", "left")
    whole = named.groupBy("doc_id", "version").agg(F.max("n").alias("n"), F.max("copies").alias("copies"), F.max("n_hit").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))
    whole = whole.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return whole.select("doc_id", F.col("n").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))
