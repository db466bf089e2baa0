from datetime import datetime, timedelta

from tendril.streaming import tracking

START = datetime(2024, 1, 1)


def run(spark, tmp_path, batches, schema, make, name):
    folder = tmp_path / "in"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "*"))
    query = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        query.processAllAvailable()
        return [tuple(r) for r in spark.sql(f"select * from {name}").collect()]
    finally:
        query.stop()


def test_first_seen(spark, tmp_path):
    rows = run(spark, tmp_path, [[(1, "a"), (2, "b")], [(1, "c"), (3, "d")]], "nid long, v string", lambda s: tracking.first_seen(s, ["nid"]), "seen")
    assert sorted(r[0] for r in rows) == [1, 2, 3]


def test_first_seen_within_a_watermark(spark, tmp_path):
    day = lambda n: START + timedelta(days=n)
    batches = [[(1, day(0)), (2, day(1)), (1, day(2))], [(1, day(5)), (3, day(60))], [(3, day(61)), (1, day(62))], [(1, day(63))]]
    rows = run(spark, tmp_path, batches, "nid long, at timestamp", lambda s: tracking.first_seen(s, ["nid"], "at", "10 days"), "seen_within")
    assert sorted(r[0] for r in rows) == [1, 1, 2, 3]  # the first one is forgotten after sixty days, and comes again once


def test_changes(spark, tmp_path):
    batches = [[(1, "a", 1), (2, "x", 1)], [(1, "a", 2), (2, None, 2)], [(1, "b", 3), (2, "x", 3)]]
    rows = run(spark, tmp_path, batches, "nid long, v string, n int", lambda s: tracking.changes(s, "nid", "v", "n"), "moved")
    assert sorted(rows, key=str) == sorted([(2, "x", None), (2, None, "x"), (1, "a", "b")], key=str)


def test_lifecycle(spark, tmp_path):
    day = lambda n: START + timedelta(days=n)
    batches = [
        [(1, "change", day(0)), (2, "change", day(0)), (3, "change", day(0))],
        [(2, "close", day(10)), (3, "change", day(50))],
        [(3, "change", day(100)), (4, "change", day(100))],
        [(2, "change", day(101)), (4, "restart", day(102))],
    ]
    rows = run(spark, tmp_path, batches, "nid long, what string, at timestamp", lambda s: tracking.lifecycle(s, "nid", "what", "at"), "life")
    states = {k: [r[1] for r in rows if r[0] == k] for k in (1, 2, 3, 4)}
    assert states[1] == ["abierta", "parada"]
    assert states[2] == ["abierta", "cerrada"]
    assert states[3] == ["abierta"]
    assert states[4] == ["abierta", "reiniciada"]
