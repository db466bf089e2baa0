"""Grouped collections in a fixed order, group columns, sums that must match."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def collected(order: Sequence[str], *columns: str) -> Column:
    """Aggregate: structs of the columns, sorted by `order`."""
    return F.array_sort(F.collect_list(F.struct(*order, *(c for c in columns if c not in order))))


def with_children(parents: DataFrame, children: DataFrame, key: Sequence[str], order: Sequence[str], columns: Sequence[str], name: str) -> DataFrame:
    """Parents with their children as an ordered array, empty where there are none. Children are gathered before the join."""
    gathered = children.groupBy(*key).agg(collected(order, *columns).alias(name))
    return parents.join(gathered, list(key), "left").withColumn(name, F.coalesce(name, F.array().cast(gathered.schema[name].dataType)))


def change_group(followed: Column, fields: Column, dates: Sequence[str]) -> Column:
    """One of three disjoint groups: followed, moved dates, other."""
    return F.when(F.coalesce(followed, F.lit(False)), "followed").when(F.exists(fields, lambda f: f.isin(*dates)), "dates").otherwise("other")


def sorted_facet(df: DataFrame, array: str) -> DataFrame:
    """Sorted distinct values of an array column."""
    return df.select(F.explode(array).alias("value")).distinct().orderBy("value")


def sum_check(parts: DataFrame, key: Sequence[str], part: str, total: Column, goal: Column) -> DataFrame:
    """(key, parts, total, matches_total, matches_goal): the sum of the parts against what is stated and what it should be."""
    summed = parts.groupBy(*key).agg(F.sum(part).alias("parts"), F.max(total).alias("total"))
    return summed.withColumns({"matches_total": F.col("parts").eqNullSafe(F.col("total")), "matches_goal": F.col("parts").eqNullSafe(goal)})


def warning_count(warnings: Sequence[tuple[Column, Column]]) -> Column:
    """Number of warnings over several readings (warnings, by_ocr), those of images left out."""
    return sum((F.when(F.coalesce(ocr, F.lit(False)), 0).otherwise(F.coalesce(F.size(w), F.lit(0))) for w, ocr in warnings), F.lit(0))


def differing(a: Column, b: Column, fields: Sequence[str]) -> Column:
    """Of two readings (structs), the fields that both have and that differ."""
    each = F.array(*(F.when(a[f].isNotNull() & b[f].isNotNull() & (a[f] != b[f]), F.lit(f)) for f in fields))
    return F.filter(each, lambda x: x.isNotNull())
