import itertools
import random

import pytest
from pyspark.sql import functions as F

from tendril.operators import ranking
from tendril.streaming import links

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def batch_links(numbers, excluded):
    """Each number's latest earlier one that is not excluded."""
    return {n: max((m for m in numbers if m < n and m not in excluded), default=None) for n in numbers}


@pytest.mark.parametrize("excluded", [(), (2,), (1, 4), (5,), (1, 2, 3, 4, 5)])
def test_any_order_of_arrival_gives_the_batch_result(excluded):
    numbers = (1, 2, 3, 4, 5)
    for order in itertools.permutations(numbers):
        for cut in range(6):
            known, last = {}, {}
            for part in (order[:cut], order[cut:], order[:2]):  # the last part comes again
                last |= links.link(known, part, [n for n in excluded if n in {*known, *part}], revise=True)
            assert known == batch_links(numbers, excluded) == {n: last[n] for n in numbers}


def test_links_that_stay_never_link_twice():
    """As by repeated runs: every number that came gets the latest earlier one which no link has taken by then."""
    for order in itertools.permutations(range(1, 7)):
        known, made = {}, {}
        for n in order:
            free = {m for m in known if m < n} - {p for p in known.values() if p is not None}
            changed = links.link(known, [n], [], revise=False)
            assert changed == ({n: max(free)} if free else {})
            made |= changed
        assert len(set(made.values())) == len(made)
    known = {}
    assert links.link(known, [1, 3], [], False) == {3: 1}
    assert links.link(known, [2], [], False) == {}  # found late: its earlier one is taken, and 3 stays as it is


def stream_links(spark, tmp_path, batches, revise, name):
    schema = "office string, name string, nid long, gone boolean"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k:03d}"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        found = links.late_links(stream, ["office", "name"], "nid", "gone", revise)
        out = str(tmp_path / "out")
        write = lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/{n}")
        query = found.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", str(tmp_path / "check")).start()
        query.processAllAvailable()
        query.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.parquet(f"{out}/*")


def test_stream_in_any_order_as_the_batch(spark, tmp_path):
    draw = random.Random(4)
    rows = [(draw.choice("xy"), draw.choice("mn"), n, draw.random() < 0.2) for n in range(60)]
    rows += [(None, "m", 100, False), (None, "m", 101, False), ("x", None, 102, None), ("x", "m", None, False)]
    shuffled = draw.sample(rows, len(rows)) + rows[:5]
    batches = [shuffled[k : k + 12] for k in range(0, len(shuffled), 12)]
    found = links.latest(stream_links(spark, tmp_path, batches, True, "late"), ["office", "name"], "nid", "batch")
    table = spark.createDataFrame(rows, "office string, name string, nid long, gone boolean").filter("nid is not null")
    taken = table.filter("gone").select(F.col("nid").alias("taken"))
    batch = ranking.asof_previous_free(table, taken, ["office", "name"], "nid").filter("previous is not null")
    columns = ["office", "name", "nid", "previous"]
    assert sorted(map(tuple, found.select(columns).collect()), key=str) == sorted(map(tuple, batch.select(columns).collect()), key=str)


def test_stream_whose_links_stay(spark, tmp_path):
    batches = [[("x", "m", 1, False), ("x", "m", 3, False)], [("x", "m", 2, False)], [("x", "m", 9, False), ("y", "m", 4, False)], [("x", "m", 10, False)]]
    found = stream_links(spark, tmp_path, batches, False, "stay").collect()
    assert sorted((r["nid"], r["previous"]) for r in found) == [(3, 1), (9, 3), (10, 9)]
