import csv

import pytest
from pyspark.sql import functions as F

from tendril.sinks import files

SCHEMA = "nid long, name string, amount string"


def table(spark, n=500):
    rows = [(k, f'Ñandú; "{k}"\nx' if k % 50 == 0 else f"é{k}", None if k % 7 == 0 else f"{k},00") for k in range(n)]
    return spark.createDataFrame(rows, SCHEMA).repartition(7), rows


def test_one_file_in_order_with_mark_and_header_once(spark, tmp_path):
    df, rows = table(spark)
    path = tmp_path / "report.csv"
    files.one_file(df, str(path), [F.desc("nid")])
    expected = tmp_path / "expected.csv"
    with open(expected, "w", newline="", encoding="utf-8-sig") as f:
        writer = csv.writer(f, delimiter=";")
        writer.writerow(["nid", "name", "amount"])
        writer.writerows([["" if v is None else v for v in r] for r in reversed(rows)])
    assert path.read_bytes() == expected.read_bytes()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["expected.csv", "report.csv"]
    files.one_file(df.filter("nid < 3"), f"file://{path}", ["nid"])  # again, in its place, by a URI
    assert path.read_text(encoding="utf-8").splitlines()[1].startswith("0;")


def test_never_over_a_file_where_asked(spark, tmp_path):
    df, _ = table(spark, 10)
    path = tmp_path / "report.csv"
    path.write_text("mine")
    with pytest.raises(Exception, match="is there already"):
        files.one_file(df, str(path), ["nid"], overwrite=False)
    assert path.read_text() == "mine" and [p.name for p in tmp_path.iterdir()] == ["report.csv"]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    df, _ = table(spark)
    fails = df.withColumn("amount", F.when(F.col("nid") == 333, F.raise_error(F.lit("boom"))).otherwise(F.col("amount")))
    with pytest.raises(Exception, match="boom"):
        files.one_file(fails, str(tmp_path / "report.csv"))
    assert list(tmp_path.iterdir()) == []


def test_an_empty_table_has_its_header(spark, tmp_path):
    df, _ = table(spark, 10)
    files.one_file(df.filter("nid < 0"), str(tmp_path / "e.csv"), ["nid"])
    assert (tmp_path / "e.csv").read_bytes() == "﻿nid;name;amount\r\n".encode()


def test_a_file_a_row_and_none_over_another(spark, tmp_path):
    rows = spark.createDataFrame([(f"{k}.toml", f"nid = {k}\n# ñ") for k in range(20)], "name string, content string").repartition(4)
    files.file_per_row(rows, str(tmp_path / "t"))
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == sorted(f"{k}.toml" for k in range(20))
    assert (tmp_path / "t" / "7.toml").read_text(encoding="utf-8") == "nid = 7\n# ñ"
    (tmp_path / "t" / "7.toml").write_text("filled")
    more = rows.filter("name = '7.toml'").union(spark.createDataFrame([("99.toml", "x")], "name string, content string"))
    with pytest.raises(Exception, match="there already"):
        files.file_per_row(more, str(tmp_path / "t"))
    assert (tmp_path / "t" / "7.toml").read_text() == "filled" and not (tmp_path / "t" / "99.toml").exists()
    with pytest.raises(Exception, match="twice"):
        files.file_per_row(spark.createDataFrame([("a", "1"), ("a", "2")], "name string, content string"), str(tmp_path / "u"))
    with pytest.raises(Exception, match="no name"):
        files.file_per_row(spark.createDataFrame([("../a", "1")], "name string, content string"), str(tmp_path / "u"))
    assert [p.name for p in tmp_path.iterdir()] == ["t"]
