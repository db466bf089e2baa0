"""Checks of hand-filled records as tables: each gives the contradictions it finds as (record, field, row, message)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _found(df: DataFrame, record: Sequence[str], field: str, row: Column, message: Column) -> DataFrame:
    return df.select(*record, F.lit(field).alias("field"), row.alias("row"), message.alias("message"))


def wrong_kinds(df: DataFrame, record: Sequence[str], kinds: Mapping[str, str | Sequence[str]]) -> DataFrame:
    """Values that are not of their column's kind: text, optional text, whole, number, or one of a list of values."""

    def bad(column: str, kind: str | Sequence[str]) -> Column:
        c = F.col(column)
        if kind == "text":
            ok = F.trim(c.cast("string")) != ""
        elif kind == "optional text":
            ok = c.isNotNull()
        elif kind == "whole":
            ok = (c > 0) & (c == F.floor(c))
        elif kind == "number":
            ok = c > 0
        else:
            ok = c.isin(*kind)
        return F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(column).alias("field"), F.concat(F.lit(f"must be {kind if isinstance(kind, str) else ' | '.join(kind)}, got "), F.coalesce(c.cast("string"), F.lit("nothing"))).alias("message")))

    each = F.filter(F.array(*(bad(c, k) for c, k in kinds.items())), lambda x: x.isNotNull())
    return df.select(*record, F.explode(each).alias("_x")).select(*record, "_x.field", F.lit("").alias("row"), "_x.message")


def amounts_that_differ(df: DataFrame, record: Sequence[str], amount: str, times: str, of: str, cent: str = "0.01") -> DataFrame:
    """Amounts further than a cent from so many times another."""
    expected = (F.col(times).cast("decimal(10,4)") * F.col(of).cast("decimal(15,2)")).cast("decimal(20,4)")
    off = F.abs(F.col(amount).cast("decimal(15,2)") - expected) > F.lit(cent).cast("decimal(3,2)")
    return _found(df.filter(off), record, amount, F.lit(""), F.concat(F.col(amount).cast("string"), F.lit(" is not "), expected.cast("string")))


def points_that_do_not_add_up(steps: DataFrame, record: Sequence[str], letter: str, part: str, points: str, most: str, goal: int = 100) -> DataFrame:
    """Steps of parts of lettered factors: each factor's parts must give `most` at their best, and all factors `goal`."""
    parts = steps.groupBy(*record, letter, part).agg(F.max(points).alias("_best"), F.max(most).alias("_most"), F.min(most).alias("_least"))
    factors = parts.groupBy(*record, letter).agg(F.sum("_best").alias("_best"), F.max("_most").alias("_most"), F.min("_least").alias("_least"))
    repeated = _found(factors.filter("_most <> _least"), record, "factors", F.col(letter).cast("string"), F.lit("every part must repeat the same maximum"))
    uneven = _found(factors.filter("_best <> _most"), record, "factors", F.col(letter).cast("string"), F.concat(F.lit("parts give "), F.col("_best").cast("string"), F.lit(", not "), F.col("_most").cast("string")))
    whole = factors.groupBy(*record).agg(F.sum("_most").alias("_sum")).filter(F.col("_sum") != goal)
    return repeated.union(uneven).union(_found(whole, record, "factors", F.lit(""), F.concat(F.lit("maxima add up to "), F.col("_sum").cast("string"))))


def unrecorded(contradictions: DataFrame, named: DataFrame, record: Sequence[str]) -> DataFrame:
    """Contradictions that no incongruence names by field and row: what is left is a mistake in the record."""
    return contradictions.join(named.select(*record, "field", "row"), [*record, "field", "row"], "left_anti")


def unknown_references(rows: DataFrame, listed: DataFrame, record: Sequence[str], array: str, name: str) -> DataFrame:
    """Names in an array column that the record's other table does not list."""
    single = rows.select(*record, F.explode(array).alias(name)).distinct()
    lost = single.join(listed.select(*record, name).distinct(), [*record, name], "left_anti")
    return _found(lost, record, array, F.lit(""), F.col(name))


def incongruence_faults(named: DataFrame, values: DataFrame, record: Sequence[str], blocks: Sequence[str], silent: Sequence[str] = ("cita", "pagina")) -> DataFrame:
    """What is wrong with a record's incongruences (field, row, column, value; "" where not given).

    values: the record's current readings as (field, row, column, value), row "" for blocks. An incongruence may name
    nothing and then has no value; it may name a field or one of its rows, again without a value; or a column of them, and
    then its value is another one than those read. Columns of `silent` have no other reading.
    """
    keys = list(record)
    cleared = named.select(*keys, *(F.coalesce(c, F.lit("")).alias(c) for c in ("field", "row", "column", "value"))).distinct()
    held = values.select(*keys, "field", "row", "column", "value")
    fields = held.select(*keys, "field").distinct().withColumn("_field", F.lit(True))
    rows = held.select(*keys, "field", "row").distinct().withColumn("_row", F.lit(True))
    columns = held.groupBy(*keys, "field", "row", "column").agg(F.collect_set("value").alias("_read"))
    # these grow with the records, and their size is estimated from small files: merged, not broadcast
    fields, rows, columns = (side.hint("merge") for side in (fields, rows, columns))
    joined = cleared.join(fields, [*keys, "field"], "left").join(rows, [*keys, "field", "row"], "left").join(columns, [*keys, "field", "row", "column"], "left")
    no = lambda c: F.col(c) == ""
    whole_field = no("row") & no("column")
    message = (
        F.when(no("field") & no("row") & no("column"), F.when(~no("value"), "value without field and column"))
        .when(no("column") & ~no("value"), "value without column")
        .when(F.col("_field").isNull(), "unknown field")
        .when(F.col("field").isin(*blocks) & ~no("row"), "a block has no rows")
        .when(~whole_field & F.col("_row").isNull(), "unknown row")
        .when(~no("column") & (F.col("_read").isNull() | F.col("column").isin(*silent)), "unknown column")
        .when(~no("column") & F.array_contains("_read", F.col("value")), "value is the reading already used")
    )
    return joined.withColumn("message", message).filter("message is not null").select(*keys, "field", "row", "column", "message")


def import_ready(filled: DataFrame, documents: DataFrame, stored: DataFrame, key: Sequence[str], fields: str, reported: str, ready: str = "ready") -> tuple[DataFrame, DataFrame]:
    """(stored records after the import, filled records refused).

    Records that are ready and whose document is listed replace what is stored if their fields differ, and then count as
    not reported; equal ones leave the row as it is. Those that are not ready wait, and are in neither table.
    """
    marked = filled.filter(F.coalesce(F.col(ready), F.lit(False)))
    listed = documents.select(*key).distinct()
    refused = marked.join(listed, list(key), "left_anti")
    fresh = marked.join(listed, list(key), "left_semi").select(*key, F.col(fields).alias("_fields"), F.lit(True).alias("_came"))
    both = stored.select(*key, fields, reported).join(fresh, list(key), "full_outer")
    new = F.coalesce("_came", F.lit(False)) & ~F.col(fields).eqNullSafe(F.col("_fields"))
    after = both.select(*key, F.when(new, F.col("_fields")).otherwise(F.col(fields)).alias(fields), F.when(~new, F.col(reported)).alias(reported))
    return after, refused
