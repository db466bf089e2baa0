import random

import pytest
from pyspark.sql import functions as F

from tendril.llm import common, ngram_join
from tendril.llm.components import connected_components


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)])


def brute(rows):
    """Components by all pairs."""
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {(d, len(sets[d]), root(d)) for d in ids}


def corpus(seed, n=90):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    bases = [[draw.choice(vocabulary) for _ in range(draw.randint(3, 120))] for _ in range(12)]
    passage = [draw.choice(vocabulary) for _ in range(40)]
    rows = []
    for k in range(n):
        words = list(draw.choice(bases))
        for _ in range(draw.randint(0, 1 + len(words) // 25)):
            words[draw.randrange(len(words))] = draw.choice(vocabulary)
        if draw.random() < 0.3:
            words += passage
        text = " ".join(words)
        rows.append((k, draw.choice([text, text.upper(), text.replace(" ", "\n", 3)])))
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \t"), (n + 3, "one two"), (n + 4, "ONE  two")]


@pytest.mark.parametrize("seed", range(2))
def test_as_brute_force(spark, seed, monkeypatch):
    rows = corpus(seed)
    if seed:  # every common key is hot, and there are very long texts
        monkeypatch.setattr(common, "HOT_ROWS", 5)
        monkeypatch.setattr(ngram_join, "HOT_ROWS", 5)
        long = [f"n{k}" for k in range(40_000)]
        rows += [(1000, " ".join(long)), (1001, " ".join([*long[:39_000], *long[:500]])), (1002, " ".join(long[:20_000]))]
    found = ngram_join.groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {tuple(r) for r in found.select("doc_id", "n_shingles", "component_id").collect()} == brute(rows)


def test_without_hub_rounds_the_same(spark):
    rows = corpus(9, 50)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = ngram_join.stored(ngram_join.shingle_sets(docs), "sets")
    found = ngram_join.link(docs, sets, hub_rounds=())
    labels = {r["node"]: r["component"] for r in found.labels.collect()}
    expected = brute(rows)
    first = {}
    for d, _, c in sorted(expected):
        first.setdefault(shingles(dict(rows)[d]), d)
    for d, n, c in expected:
        if n and first[shingles(dict(rows)[d])] == d:
            assert labels.get(d, d) == c


def test_chain_of_links_is_one_component(spark):
    words = [f"v{i}" for i in range(140)]
    rows = [(k, " ".join(words[k * 4 : k * 4 + 80])) for k in range(15)]
    found = ngram_join.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(r) for r in found} == brute(rows)
    assert {r["component_id"] for r in found} == {0}


def test_large_group_of_copies_and_near_copies(spark):
    words = [f"u{i}" for i in range(100)]
    near = lambda k: " ".join([*words[: k % 90], f"x{k}", *words[k % 90 + 1 :]])
    rows = [(k, " ".join(words) if k % 3 == 0 else near(k)) for k in range(240)]
    found = ngram_join.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == 240
    assert {tuple(r) for r in found} == brute(rows)


def test_bounds_never_drop_a_link():
    draw = random.Random(3)
    for _ in range(200):
        n = draw.randint(1, 400)
        a = set(draw.sample(range(10**6), n))
        b = set(draw.sample(sorted(a), n - draw.randint(0, n // 10))) | set(draw.sample(range(10**6, 2 * 10**6), draw.randint(0, n // 20)))
        import numpy as np

        hashed = lambda s: np.array(sorted(hash((x, "salt")) & (2**64 - 1) for x in s), np.uint64)
        differing = sum(bin(int(x) & (2**64 - 1)).count("1") for x in ngram_join.bitmap(hashed(a)) ^ ngram_join.bitmap(hashed(b)))
        assert differing <= len(a ^ b)


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(5, "a b c d e f", 1, "k"), (5, "a b c d e f", 2, "k"), (3, "a b c d e f", 3, None), (None, "a b c d e f", 4, "k"), (8, None, 5, "k"), (9, "other words here", 6, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long, component_id string")
    found = sorted(ngram_join.groups(docs).collect(), key=str)
    assert len(found) == 6
    assert {r["component_id"] for r in found if r["n_shingles"] == 2} == {3}
    kept = ngram_join.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == [3, 8, 9]


def test_one_id_of_repeated_rows_stays(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "c d")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in ngram_join.representatives(docs).collect()) == [1, 2]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.groups(docs).count() == 0
    assert ngram_join.representatives(docs).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 9), (1, 2)], "a long, b long")
    assert {tuple(r) for r in connected_components(links).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}
    star = spark.range(1, 500).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    assert connected_components(star).filter("component <> 0").count() == 0
