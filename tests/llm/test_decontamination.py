import random
import re

import pytest
from pyspark.sql import functions as F

from tendril.llm import common, decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w, hit, met = words(text), set(), set()
        for window, own in windows.items():
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    met |= own
        out.append((doc_id, len(w), len(hit), len(met), sorted(met), bool(hit)))
    return sorted(out, key=str)


def found(spark, docs, items):
    df = decontamination.scan(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return sorted((tuple(r) for r in df.collect()), key=str)


def corpus(seed):
    draw = random.Random(seed)
    vocabulary = ["Über", "straße", *(f"w{i}" for i in range(12))]
    items = [(k, " ".join(draw.choice(vocabulary) for _ in range(draw.choice([1, 3, 4, 6, 9, 10, 11, 25, 40])))) for k in range(25)]
    items += [(100, items[0][1]), (101, None), (102, "..."), (None, items[1][1]), (100, items[2][1])]
    docs = []
    for k in range(60):
        parts = [draw.choice(vocabulary) for _ in range(draw.randint(0, 60))]
        for _ in range(draw.randint(0, 3)):
            w = words(draw.choice(items)[1])
            at = draw.randint(0, max(0, len(w) - 4))
            parts[draw.randint(0, len(parts)) : 0] = w[at : at + draw.randint(3, 30)]
        text = draw.choice([" ", ", ", "\n"]).join(parts)
        docs.append((k, draw.choice([text, text.upper(), text.title()])))
    return [*docs, docs[3], docs[3], (3, "other text"), (None, docs[5][1]), (None, None), (90, ""), (91, "!?")], items


@pytest.mark.parametrize("seed,small", [(0, True), (1, True), (2, False)])
def test_as_brute_force(spark, seed, small, monkeypatch):
    if not small:  # nothing is broadcast, and every common shingle and window is hot
        monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
        monkeypatch.setattr(common, "HOT_ROWS", 3)
    docs, items = corpus(seed)
    assert found(spark, docs, items) == brute(docs, items)


def test_short_and_equal_windows_ties_and_bounds(spark):
    items = [(1, "a b"), (2, "a a a a a a a a a a a a"), (3, "x y z v w a b c d e"), (10, "x y z v w a b c d e f")]
    docs = [(k, t) for k, t in enumerate(["a b", "b a", "a a a a a a a a a", "a " * 30, "y z v w a b c d e f", "x y z v w a b c d e", "q x y z v w a b c d e f q", "x y z v w a b c d"])]
    assert found(spark, docs, items) == brute(docs, items)
    assert [r[4] for r in found(spark, [(1, docs[6][1])], items)] == [["1", "10", "3"]]  # sorted as strings


def test_empty_tables_and_other_columns(spark):
    docs, items = corpus(4)
    assert found(spark, docs[:5], []) == brute(docs[:5], [])
    assert found(spark, [], items) == []
    wide = spark.createDataFrame([(*d, 1, 2, ["x"]) for d in docs], "doc_id long, text string, n int, p int, words array<string>")
    other = spark.createDataFrame([(*i, 3, "q") for i in items], "item_id long, text string, size int, window string")
    assert sorted((tuple(r) for r in decontamination.scan(wide, other).collect()), key=str) == brute(docs, items)


def test_very_long_text(spark):
    draw = random.Random(5)
    long = " ".join(draw.choice("abcdefgh") * draw.randint(1, 3) for _ in range(200_000))
    item = " ".join(f"k{i}" for i in range(30))
    assert found(spark, [(1, f"{long} {item} {long}"), (2, f"{item} " * 5_000)], [(7, item)]) == [(1, 400_030, 30, 1, ["7"], True), (2, 150_000, 150_000, 1, ["7"], True)]


def test_no_python_in_the_plan(spark):
    docs, items = corpus(6)
    df = decontamination.scan(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    df = df.select("doc_id", F.sha2(F.array_join("items", ","), 256))
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
