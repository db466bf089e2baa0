"""Reports as files. The rows are made by Spark; only bounded summaries come to the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOM = "﻿"


def write_csv(df: DataFrame, path: str) -> None:
    """`;`-separated UTF-8 with a header that carries the byte order mark, nulls empty; one file a partition."""
    names = df.columns
    marked = df.withColumnRenamed(names[0], BOM + names[0])
    marked.write.mode("overwrite").option("sep", ";").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def flattened_changes(groups: DataFrame, key: Sequence[str], changes: str) -> DataFrame:
    """A row for each change of each group."""
    return groups.select(*key, F.explode(changes).alias("_c")).select(*key, "_c.*")


def unpivoted(df: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """A row for each field that has a value: (key, field, value as text)."""
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))
    return df.select(*key, F.explode(each).alias("_f")).select(*key, "_f.field", "_f.value").filter("value is not null")


def summary(df: DataFrame, block: str, line: Column, order: Sequence[Column], k: int = 10) -> DataFrame:
    """(block, n, text): the first k lines of each block as a list, and how many more there are. Ranked before gathering."""
    from ..operators.ranking import top_with_rest

    top = top_with_rest(df.withColumn("_line", line), [block], order, k)
    gathered = top.groupBy(block).agg(F.array_sort(F.collect_list(F.struct("place", "_line"))).alias("_lines"), F.max("more").alias("_more"))
    text = F.array_join(F.transform("_lines", lambda x: F.concat(F.lit("- "), x["_line"])), "\n")
    rest = F.when(F.col("_more") > 0, F.concat(F.lit("\n… y "), F.col("_more").cast("string"), F.lit(" más"))).otherwise("")
    return gathered.select(block, (F.size("_lines") + F.col("_more")).alias("n"), F.concat(text, rest).alias("text"))


def unreported(df: DataFrame, markers: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.join(markers.select(*key), list(key), "left_anti")


def mark_reported(df: DataFrame, path: str, key: Sequence[str]) -> None:
    """Append the keys to the markers, after the sink took them: a report that fails half-way is sent again."""
    df.select(*key).distinct().write.mode("append").parquet(path)
