"""Parquet tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read by Spark alone, so that any store it knows will do; filters and columns reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows that much is made of, dealt over the cores first: a small file comes to one task, whatever each of its rows costs."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
