"""Newest-per-group, as-of links, latest versions, running budgets: windows and one-pass aggregates with total orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_per_group(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group in the given order, which must be total."""
    return ranked(df, key, order).filter("place = 1").drop("place")


def ranked(df: DataFrame, key: Sequence[str], order: Sequence[Column], name: str = "place") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def newest_flag(df: DataFrame, key: Sequence[str], order: Sequence[Column], name: str = "newest") -> DataFrame:
    """All rows; a boolean tells the first of each group."""
    return ranked(df, key, order, name).withColumn(name, F.col(name) == 1)


def latest_values(df: DataFrame, key: Sequence[str], kind: str, value: str, order: Column, kinds: Sequence[str]) -> DataFrame:
    """One row a key with the newest value of each kind, in one aggregate: kinds are the columns of the result."""
    newest = [F.max_by(F.when(F.col(kind) == k, F.col(value)), F.when(F.col(kind) == k, order)).alias(k) for k in kinds]
    return df.groupBy(*key).agg(*newest)


def asof_previous(df: DataFrame, key: Sequence[str], at: str, name: str = "previous") -> DataFrame:
    """The nearest earlier `at` of the same key, by a window: no row is taken out of the choice."""
    return df.withColumn(name, F.lag(at).over(Window.partitionBy(*key).orderBy(at)))


def asof_previous_free(df: DataFrame, links: DataFrame, key: Sequence[str], at: str, name: str = "previous") -> DataFrame:
    """As `asof_previous`, but rows whose `at` a link already takes (column `taken`) are passed over, farther ones being looked at.

    A running maximum over the free rows gives what an as-of join would, without a join on ranges.
    """
    used = links.select(F.col("taken").alias(at), F.lit(True).alias("_used")).distinct()
    marked = df.join(used, at, "left")
    before = Window.partitionBy(*key).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    return marked.withColumn(name, F.max(F.when(F.col("_used").isNull(), F.col(at))).over(before)).drop("_used")


def last_by_prefix(history: DataFrame, stages: DataFrame, key: str, text: str, stage: str, order: Sequence[Column]) -> DataFrame:
    """For each (key, stage) the newest history text that starts with "stage: "; the prefix is cut off and joined on, not searched."""
    split = history.withColumn(stage, F.substring_index(text, ": ", 1)).filter(F.col(text).contains(": "))
    newest = newest_per_group(split, [key, stage], order)
    return stages.join(newest.select(key, stage, text), [key, stage])


def within_budget(df: DataFrame, group: Sequence[str], order: Sequence[Column], cost: Column, cap: Column) -> DataFrame:
    """Rows in order while what was spent before them, by group, is under the cap. Column spent: before the row."""
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("spent", F.coalesce(F.sum(cost).over(before), F.lit(0))).filter(F.col("spent") < cap)


def top_with_rest(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group with their place, and how many more the group has."""
    sizes = df.groupBy(*group).agg(F.greatest(F.count("*") - k, F.lit(0)).alias("more"))
    # the filter on the place lets every task drop all but its own first k before the shuffle
    return ranked(df, group, order).filter(F.col("place") <= k).join(sizes, list(group))


def quantile_step(df: DataFrame, value: Column, steps: int = 500) -> Column:
    """The step of a number among approximate quantiles of all rows' values, ascending from 0; null for null.

    At most `steps` numbers come to the driver, and steps hold about as many rows each, whatever the values' range; equal
    values are in one step.
    """
    cuts = df.select(value.cast("double").alias("v")).agg(F.percentile_approx("v", [k / steps for k in range(1, steps)], 10 * steps)).first()[0]
    bounds = F.expr("cast(split('" + ",".join(map(repr, sorted(set(cuts)))) + "', ',') as array<double>)") if cuts else F.array().cast("array<double>")
    return F.when(value.isNotNull(), F.size(F.filter(bounds, lambda c: c < value.cast("double"))))


def global_place(df: DataFrame, coarse: Sequence[Column], order: Sequence[Column], group: Sequence[str] = (), name: str = "place") -> DataFrame:
    """Place of every row in a total order (by group), without a task that sees them all.

    coarse: sort keys that cut the order into steps, some thousands at most whatever the rows (days, `quantile_step`): rows
    are numbered within their step, and the steps' counts are added up before. Rows that have no value are one step unless
    a further key of `coarse` cuts them: the next key of the order, by its quantiles. The counts are joined back as their
    measured size allows, by broadcast or by shuffle.
    """
    steps = [f"_step{k}" for k in range(len(coarse))]
    keyed = df
    directions = []
    for name_, c in zip(steps, coarse, strict=True):
        keyed = keyed.withColumn(name_, c)
        directions.append(F.col(name_).asc_nulls_last())
    before = Window.partitionBy(*group).orderBy(*directions).rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy(*group, *steps).agg(F.count("*").alias("_n"))
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n").alias("o")
    local = keyed.withColumn("_row", F.row_number().over(Window.partitionBy(*group, *steps).orderBy(*order))).alias("l")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"o.{c}")) for c in (*group, *steps)]
    return local.join(offsets, same).select("l.*", (F.col("_row") + F.col("_before")).alias(name)).drop("_row", *steps)


def islands(df: DataFrame, key: Sequence[str], number: str) -> DataFrame:
    """Runs of consecutive numbers of each key: (key, first, last)."""
    single = df.select(*key, number).distinct()
    run = F.col(number) - F.row_number().over(Window.partitionBy(*key).orderBy(number))
    return single.withColumn("_run", run).groupBy(*key, "_run").agg(F.min(number).alias("first"), F.max(number).alias("last")).drop("_run")
