"""What the operators of this subpackage share: stored tables, words and shingle hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that a Python function of a task works on at a time.
SLICE_BYTES = 1 << 20
#: A table is broadcast only if its bytes, summed before, are not more than this.
BROADCAST_BYTES = 32 << 20


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="tendril-shared-")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir.

    Where it is unset, a local session takes a folder of its own; on a cluster that is an error, since executors could
    not read what the driver's machine holds.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        return _local_folder()
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back.

    This cuts the lineage: what follows survives lost executors without computing the input again.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._stored_at = path
    return kept


def dropped(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read again (what was made of them is stored itself)."""
    for df in tables:
        path = getattr(df, "_stored_at", None)
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bounded(ids: DataFrame) -> DataFrame:
    """A stored table of one or two numbers a row, marked for broadcast if its bytes are few."""
    return F.broadcast(ids) if 16 * ids.count() <= BROADCAST_BYTES else ids


# --- joins on keys that may hold a third of all rows --------------------------------------------------------------

#: Rows of one key from which its rows are spread, and how many such keys at most: the others hold a smaller share of all.
HOT_ROWS, MOST_HOT = 1000, 100_000


def hot_keys(counts: DataFrame, on: list[str], count: str = "n") -> DataFrame | None:
    """Stored table (on, parts) of the keys with over HOT_ROWS rows, the hottest MOST_HOT at most; None if there are none."""
    hot = counts.filter(F.col(count) > HOT_ROWS).select(*on, F.ceil(F.col(count) / HOT_ROWS).cast("int").alias("parts"))
    hot = stored(hot, "hot")
    found = hot.count()
    if found > MOST_HOT:
        hot = stored(hot.orderBy(F.desc("parts")).limit(MOST_HOT), "hottest")
    return hot if found else None


def spread_join(left: DataFrame, right: DataFrame, on: list[str], hot: DataFrame | None, by: str, how: str = "inner") -> DataFrame:
    """left joined to right, with the rows of hot keys of left dealt over parts by the column `by`; right is repeated for each part.

    Without hot keys every key has one part, so that the join has one form at every size of the tables.
    """
    if hot is None:
        left, right = left.withColumn("parts", F.lit(1)), right.withColumn("parts", F.lit(1))
    else:
        left, right = left.join(F.broadcast(hot), on, "left"), right.join(F.broadcast(hot), on, "left")
    parts = F.coalesce("parts", F.lit(1))
    # no constant where there are no hot keys: that would be taken out of the join's keys
    dealt = left.withColumn("_part", F.pmod(F.xxhash64(by), parts.cast("long")).cast("int")).drop("parts")
    repeated = right.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return dealt.join(repeated, [*on, "_part"], how).drop("_part")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows with about `most` bytes of text; a longer row is a run of its own."""
    total = np.ones(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type):
            total += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(total)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def map_columns(df: DataFrame, columns: list[str], function: Callable, schema: str, most: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow over the named columns only; function takes and returns a batch. What it holds at a time is bounded by `slices`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most):
                yield function(part)

    return df.select(*columns).mapInArrow(run, schema)


def split_words(text: str) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` as UTF-8, A-Z in lower case. bytes.split and bytes.lower know ASCII alone, which is just that rule."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def mix(hashes: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = hashes * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` word hashes; of the whole sequence where it is shorter (and not empty)."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(width, n)
    out = np.full(n - size + 1, size, dtype=np.uint64)
    for k in range(size):
        out = mix(out ^ hashes[k : n - size + 1 + k])
    return out


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; empty without words."""
    return np.unique(window_hashes(word_hashes(split_words(text or "")), width))
