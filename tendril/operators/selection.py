"""What is to be done next: bases to read, newest bases, queues of documents, tenders to report.

Documents have (doc, tender, type, path, state, published, unpacked): state `done` once downloaded, unpacked null until an
archive has been opened or found broken. Contents have (doc, content, path, error). Readings have (doc, version, at, fields
of their reader); a version is the reader's name, a dash and a number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import overlaps_or_empty
from .lookups import like_any
from .ranking import global_place, quantile_step

# How bases are called, which of them are the final ones, and archives.
BASES, FINAL, ARCHIVES = "bases%", "%integrad%", ("%.zip", "%.rar", "%.7z")


def newest_order() -> list[Column]:
    """The bases that a tender is offered on: the final ones first, then the latest."""
    return [F.col("type").ilike(FINAL).desc(), F.col("published").desc_nulls_last(), F.col("doc").desc()]


def is_ready() -> Column:
    """An archive waits until it has been unpacked or found broken."""
    return ~F.coalesce(like_any(F.col("path"), ARCHIVES), F.lit(False)) | F.col("unpacked").isNotNull()


def downloaded_bases(documents: DataFrame) -> DataFrame:
    """Downloaded bases with `newest`; whether they are ready does not matter for which is the newest."""
    newest = F.row_number().over(Window.partitionBy("tender").orderBy(*newest_order())) == 1
    return documents.filter((F.col("state") == "done") & F.col("type").ilike(BASES)).withColumn("newest", newest)


def with_contents(bases: DataFrame, contents: DataFrame) -> DataFrame:
    """bases with `contents`: the paths of their files, in order, broken ones left out; none for what is no archive."""
    good = contents.filter(F.col("path").isNotNull() & F.col("error").isNull()).select("doc", "content", "path")
    listed = good.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("content", "path"))), lambda c: c["path"]).alias("contents"))
    return bases.join(listed, "doc", "left").withColumn("contents", F.coalesce("contents", F.array().cast("array<string>")))


def newest_bases(documents: DataFrame, contents: DataFrame) -> DataFrame:
    """The bases that each tender is offered on now, if they are ready, with their files."""
    return with_contents(downloaded_bases(documents).filter("newest").filter(is_ready()).drop("newest"), contents)


def latest_reading(readings: DataFrame, reader: str, value: str) -> DataFrame:
    """(doc, value): of each document the newest reading of one reader, whatever its version; a prefix of the version is compared."""
    own = readings.filter(F.col("version").startswith(f"{reader}-"))
    return own.groupBy("doc").agg(F.max_by(value, F.struct("at", "version")).alias(value))


def bases_to_read(documents: DataFrame, contents: DataFrame, readings: DataFrame, version: str, amount: str = "amount") -> DataFrame:
    """Ready bases without a reading of this version, with `newest`, their files, and the amount that an earlier reading found in them."""
    unread = downloaded_bases(documents).filter(is_ready()).join(readings.filter(F.col("version") == version).select("doc"), "doc", "left_anti")
    return with_contents(unread, contents).join(latest_reading(readings, "amount", amount), "doc", "left")


def queue(documents: DataFrame, todo: Column, order: str = "doc") -> DataFrame:
    """(todo, order, place) of the documents for which something is to be done, each queue in the order of its numbers."""
    waiting = documents.withColumn("todo", todo).filter("todo is not null")
    placed = global_place(waiting, [quantile_step(waiting, F.col(order))], [F.asc(order)], ["todo"])
    return placed.select("todo", order, F.col("place").cast("long").alias("place"))


def pending(tenders: DataFrame, regions: Sequence[str], days: Column, key: str) -> DataFrame:
    """Tenders not reported yet in the watched regions, or of no region that is known, with their place: the most urgent first, those without a limit last.

    days: whole days left. A day with very many tenders, and those without a limit, are cut further by their key.
    """
    wanted = tenders.filter("reported is null").filter(overlaps_or_empty(F.col("regions"), regions)).withColumn("_days", days)
    return global_place(wanted, [F.col("_days"), quantile_step(wanted, F.col(key))], [F.col("_days").asc_nulls_last(), F.asc(key)]).drop("_days")
