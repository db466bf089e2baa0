from decimal import Decimal

from tendril.operators import records as R


def test_kinds(spark):
    df = spark.createDataFrame([(1, "a", 3, 2.5, "x"), (2, " ", 0, -1.0, "z"), (3, None, 7, 1.0, None)], "nid long, t string, w int, n double, e string")
    found = {(r["nid"], r["field"]) for r in R.wrong_kinds(df, ["nid"], {"t": "text", "w": "whole", "n": "number", "e": ["x", "y"]}).collect()}
    assert found == {(2, "t"), (2, "w"), (2, "n"), (2, "e"), (3, "t"), (3, "e")}


def test_amounts(spark):
    df = spark.createDataFrame([(1, Decimal("150.00"), Decimal("1.5"), Decimal("100.00")), (2, Decimal("150.02"), Decimal("1.5"), Decimal("100.00")), (3, Decimal("150.01"), Decimal("1.5"), Decimal("100.00"))], "nid long, m decimal(15,2), t decimal(10,4), c decimal(15,2)")
    assert [r["nid"] for r in R.amounts_that_differ(df, ["nid"], "m", "t", "c").collect()] == [2]


def test_points_and_contradictions(spark):
    steps = [(1, "A", "a", 60, 60), (1, "A", "a", 10, 60), (1, "B", "b", 20, 40), (1, "B", "c", 20, 40), (2, "A", "a", 50, 60), (3, "A", "a", 50, 50), (3, "A", "b", 50, 60)]
    df = spark.createDataFrame(steps, "nid long, letter string, part string, points int, most int")
    found = R.points_that_do_not_add_up(df, ["nid"], "letter", "part", "points", "most")
    assert {(r["nid"], r["row"]) for r in found.collect()} == {(2, "A"), (2, ""), (3, "A"), (3, "")}
    named = spark.createDataFrame([(2, "factors", "A"), (2, "factors", "")], "nid long, field string, row string")
    assert {r["nid"] for r in R.unrecorded(found, named, ["nid"]).collect()} == {3}


def test_references(spark):
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"])], "nid long, names array<string>")
    listed = spark.createDataFrame([(1, "a"), (2, "a")], "nid long, name string")
    assert [(r["nid"], r["message"]) for r in R.unknown_references(rows, listed, ["nid"], "names", "name").collect()] == [(1, "b")]
