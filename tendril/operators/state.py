"""Tracked state as pure functions: old snapshot and input give the new snapshot, and what changed.

Parquet tables have no MERGE. Each function is one join or aggregate on the key, so it shuffles each side once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_simple


def insert_if_new(old: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Old rows untouched, and the first new row of each key that is not there."""
    first = new.withColumn("_place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_place = 1").drop("_place")
    return old.unionByName(first.join(old.select(*key), list(key), "left_anti").select(*old.columns))


def document_key(uuid: Column, *names: Column) -> Column:
    """One key for both rules of uniqueness: the uuid, or without one what names the document."""
    return F.coalesce(uuid, F.concat(F.lit("~"), F.sha2(F.concat_ws("\x1f", *(F.coalesce(n, F.lit("")) for n in names)), 256)))


def upsert_latest(old: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row a key: the last by order of old and new rows."""
    both = old.unionByName(new)
    return both.withColumn("_place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_place = 1").drop("_place")


def changed_rows(old: DataFrame, new: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """New rows that are not there or differ in `value`, null-safe."""
    before = old.select(*key, F.col(value).alias("_before"), F.lit(True).alias("_there"))
    return new.join(before, list(key), "left").filter(F.col("_there").isNull() | ~F.col("_before").eqNullSafe(F.col(value))).drop("_before", "_there")


def upsert_if_changed(old: DataFrame, new: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    changed = changed_rows(old, new, key, value)
    return old.join(changed.select(*key), list(key), "left_anti").unionByName(changed)


def add_up(old: DataFrame, new: DataFrame, key: Sequence[str], totals: Sequence[str]) -> DataFrame:
    """Totals by key, new ones added to old ones."""
    return old.select(*key, *totals).unionByName(new.select(*key, *totals)).groupBy(*key).agg(*(F.sum(t).alias(t) for t in totals))


def replace_group(old: DataFrame, new: DataFrame, parent: Sequence[str]) -> DataFrame:
    """All rows of the parents that come anew are replaced."""
    return old.join(new.select(*parent).distinct(), list(parent), "left_anti").unionByName(new.select(*old.columns))


def with_previous(old: DataFrame, new: DataFrame, key: Sequence[str], column: str, name: str) -> DataFrame:
    """New rows with what the column held before."""
    return new.join(old.select(*key, F.col(column).alias(name)), list(key), "left")


def field_changes(old: DataFrame, new: DataFrame, key: Sequence[str], fields: Sequence[str], keep_old_on_null: Sequence[str] = ()) -> DataFrame:
    """(key, field, before, after) as text for each field that differs, of keys on both sides; a first reading is no change.

    Fields of `keep_old_on_null` do not count where the new value is null.
    """
    left = old.select(*key, *(F.col(f).alias(f"_old_{f}") for f in fields))
    both = left.join(new.select(*key, *fields), list(key))
    each = []
    for f in fields:
        differs = ~F.col(f"_old_{f}").eqNullSafe(F.col(f))
        if f in keep_old_on_null:
            differs = differs & F.col(f).isNotNull()
        each.append(F.when(differs, F.struct(F.lit(f).alias("field"), F.col(f"_old_{f}").cast("string").alias("before"), F.col(f).cast("string").alias("after"))))
    return both.select(*key, F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("_c")).select(*key, "_c.field", "_c.before", "_c.after")


def keyed_differences(old: DataFrame, new: DataFrame, key: Sequence[str], values: Sequence[str], order: str) -> DataFrame:
    """Rows that came, went or differ in `values`; order: old rows by their place, then new ones. Null-safe; other columns don't count."""
    a = old.select(*key, F.col(order).alias("_old_at"), F.struct(*values).alias("before"))
    b = new.select(*key, F.col(order).alias("_new_at"), F.struct(*values).alias("after"))
    both = a.join(b, list(key), "full_outer").filter(~F.col("before").eqNullSafe(F.col("after")))
    kind = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "gone").otherwise("moved")
    place = F.struct(F.col("_old_at").isNull().alias("is_new"), F.coalesce("_old_at", "_new_at").alias("at"))
    return both.select(*key, kind.alias("kind"), "before", "after", place.alias("place"))


def retry_state(outcomes: DataFrame, key: Sequence[str], ok: Column, order: Sequence[Column], most: int = 3) -> DataFrame:
    """Fold of outcomes in order: (key, attempts since the last success, state done, pending or error)."""
    run = Window.partitionBy(*key).orderBy(*order)
    seen = outcomes.withColumn("_ok", ok).withColumn("_n", F.row_number().over(run))
    folded = seen.groupBy(*key).agg(F.max(F.when(F.col("_ok"), F.col("_n"))).alias("_last_ok"), F.max("_n").alias("_n"))
    attempts = F.col("_n") - F.coalesce("_last_ok", F.lit(0))
    state = F.when(attempts == 0, "done").when(attempts >= most, "error").otherwise("pending")
    return folded.select(*key, attempts.cast("long").alias("attempts"), state.alias("state"))


def last_activity(*times: Column) -> Column:
    """The latest of several clocks; missing ones are passed over."""
    return F.greatest(*times)


def next_state(state: Column, closes: Column, restarted: Column, changed: Column, idle: Column) -> Column:
    """One step of the lifecycle. cerrada and reiniciada are final."""
    return (
        F.when(state.isin("cerrada", "reiniciada"), state)
        .when(F.coalesce(restarted, F.lit(False)), "reiniciada")
        .when(F.coalesce(closes, F.lit(False)), "cerrada")
        .when((state == "parada") & F.coalesce(changed, F.lit(False)), "abierta")
        .when((state == "abierta") & F.coalesce(idle, F.lit(False)), "parada")
        .otherwise(state)
    )


def lifecycle(events: DataFrame, key: Sequence[str], what: str, order: Sequence[Column]) -> DataFrame:
    """State after all events in order; `what` is close, restart, change or idle. As an aggregate, without a fold:

    the first close or restart is final; before one, the last idle or change decides (an idle opens nothing).
    """
    run = Window.partitionBy(*key).orderBy(*order)
    seen = events.withColumn("_n", F.row_number().over(run))
    final = F.min_by(F.when(F.col(what).isin("close", "restart"), F.col(what)), F.when(F.col(what).isin("close", "restart"), F.col("_n")))
    moved = F.max_by(F.when(F.col(what).isin("idle", "change"), F.col(what)), F.when(F.col(what).isin("idle", "change"), F.col("_n")))
    folded = seen.groupBy(*key).agg(final.alias("_final"), moved.alias("_moved"))
    state = F.when(F.col("_final") == "close", "cerrada").when(F.col("_final") == "restart", "reiniciada").when(F.col("_moved") == "idle", "parada").otherwise("abierta")
    return folded.select(*key, state.alias("state"))


def without_echo(changes: DataFrame, field: str, moved: DataFrame, key: Sequence[str]) -> DataFrame:
    """Changes without those of `field` for keys in `moved`: a moved offer stage already says that the deadline moved."""
    said = moved.select(*key).distinct().withColumn("field", F.lit(field))
    return changes.join(said, [*key, "field"], "left_anti")


def with_last_change(state: DataFrame, changes: DataFrame, key: Sequence[str], at: str, name: str = "last_change") -> DataFrame:
    """State whose `name` is the latest of what it was and of its changes' times; keys without changes keep it."""
    latest = changes.groupBy(*key).agg(F.max(at).alias("_latest"))
    return state.join(latest, list(key), "left").withColumn(name, F.greatest(name, "_latest")).drop("_latest")


def search_plan(configured: DataFrame, tracked: DataFrame, label: str, since: str, today: Column, days: int) -> DataFrame:
    """(label, first day) of each search: labels configured or still tracked, joined by what they are without accents and case.

    The window is the last `days`, stretched back to the oldest tracked one of the label. The configured spelling stays.
    """
    key = lambda df: df.withColumn("_key", normalize_simple(F.col(label)))
    mine = key(configured).groupBy("_key").agg(F.min(label).alias("_mine"))
    theirs = key(tracked).groupBy("_key").agg(F.min(label).alias("_theirs"), F.min(since).alias("_oldest"))
    recent = F.date_sub(today, days)
    return mine.join(theirs, "_key", "full_outer").select(F.coalesce("_mine", "_theirs").alias(label), F.least(recent, F.coalesce(F.col("_oldest").cast("date"), recent)).alias("first_day"))


def located_over(old_source: Column, old: Column, new_marked: Column, new_bare: Column, doubted: Column | None = None) -> Column:
    """(regions, source): a marked name beats `bases` and `entity`; a bare mention beats only nothing and `bases`.

    doubted: the reading has warnings (another code, say). Then it may be of another work: it places nothing, and takes
    back what earlier `bases` gave.
    """
    if doubted is not None:
        sure = ~F.coalesce(doubted, F.lit(False))
        kept = located_over(old_source, old, F.when(sure, new_marked), F.when(sure, new_bare))
        return F.when(~sure & (old_source == "bases"), F.struct(F.slice(old, 1, 0).alias("regions"), F.lit("unknown").alias("source"))).otherwise(kept)
    has = lambda x: F.coalesce(F.size(x), F.lit(0)) > 0
    marked = has(new_marked) & F.coalesce(old_source.isin("bases", "entity", "unknown"), F.lit(True))
    bare = has(new_bare) & F.coalesce(old_source.isin("bases", "unknown"), F.lit(True))
    return F.when(marked, F.struct(new_marked.alias("regions"), F.lit("bases").alias("source"))).when(bare, F.struct(new_bare.alias("regions"), F.lit("bases").alias("source"))).otherwise(F.struct(old.alias("regions"), old_source.alias("source")))
