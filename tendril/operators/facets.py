"""Facets beside a listing: how many rows of each value are found, and how many may be once they are read."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .filters import Filters, verdict


def listing_facets(df: DataFrame, filters: Filters, now: Column, facets: Mapping[str, Column]) -> DataFrame:
    """(facet, value, found, unread, every): counts of rows by verdict for each value of each facet, and for all rows (facet and value null).

    facets: columns by name; of an array each distinct value counts. A row is expanded to its values, as grouping sets
    are, and counts are summed before the shuffle: one scan, one exchange, whose rows are the values and not the table.
    Rows without a value of a facet are not counted there.
    """
    judged = df.select(verdict(filters.predicates(now)).alias("_verdict"), *(c.alias(f"_{n}") for n, c in facets.items()))
    parts = [F.array(F.struct(F.lit(None).cast("string").alias("facet"), F.lit(None).cast("string").alias("value")))]
    for name in facets:
        own = F.col(f"_{name}")
        many = isinstance(judged.schema[f"_{name}"].dataType, T.ArrayType)
        values = F.array_distinct(F.coalesce(own.cast("array<string>"), F.array().cast("array<string>"))) if many else F.array(own.cast("string"))
        parts.append(F.transform(F.filter(values, lambda v: v.isNotNull()), _entry(name)))
    expanded = judged.select("_verdict", F.explode(F.concat(*parts)).alias("_f")).select("_verdict", "_f.facet", "_f.value")
    return expanded.groupBy("facet", "value").agg(F.count_if(F.col("_verdict") == "si").alias("found"), F.count_if(F.col("_verdict") == "sin_leer").alias("unread"), F.count("*").alias("every"))


def _entry(name: str):
    return lambda v: F.struct(F.lit(name).alias("facet"), v.alias("value"))
