"""Results between stages, written into the folder that all executors share, so that each stage is computed once and survives lost executors."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="tendril-stages-")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet under spark.checkpoint.dir and read back. Without that setting a local session takes a folder of its own; on a cluster it is an error."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _own_folder()
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
