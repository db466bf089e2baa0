import hashlib
import random

import numpy as np
import pytest

from tendril.llm import fingerprints as P
from tendril.llm.common import shingle_set


def edited(a, b):
    half = len(a) // 2
    return a[: len(a) - half] + b[:half]


def corpus():
    draw = random.Random(5)
    words = [f"w{i}é" for i in range(300)]
    rows = [(k * 3, " ".join(draw.choice(words) for _ in range(draw.choice([0, 1, 4, 30, 200, 2000])))) for k in range(60)]
    rows[7] = (rows[7][0], rows[6][1])
    rows[9] = (rows[9][0], None)
    return rows


def test_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(P, "RANGE_ROWS", 7)
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fingerprint string").repartition(5)
    found = {r["doc_id"]: r for r in P.compare_with_next(docs).collect()}
    assert len(found) == len(rows)
    texts = [t or "" for _, t in rows]
    for (doc_id, _), this, after in zip(rows, texts, texts[1:] + texts[:1], strict=True):
        r, changed = found[doc_id], edited(this, after)
        a, b, c = (P.sketch(shingle_set(t)) for t in (this, changed, after))
        assert r["n_chars"] == len(this)
        assert r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == (P.fingerprint(a), P.fingerprint(b))
        assert (r["near_edited"], r["near_next"]) == (P.likeness(a, b), P.likeness(a, c))
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1


def test_estimates_are_near_the_truth():
    draw = np.random.default_rng(1)
    for share in (0.1, 0.5, 0.9):
        big = draw.integers(0, 2**64, 40_000, dtype=np.uint64)
        small = np.unique(np.concatenate([big[: int(4000 * share)], draw.integers(0, 2**64, 4000 - int(4000 * share), dtype=np.uint64)]))
        assert P.containment(P.sketch(small), P.sketch(np.unique(big))) == pytest.approx(share, abs=0.08)


def test_short_texts_in_long_ones():
    """Against exact sets: two short ones exactly, a short one in a long one nearly always found."""
    draw = random.Random(3)
    words = [f"v{i}" for i in range(5000)]
    seen = {}
    for _ in range(300):
        n = draw.choice([5, 8, 16, 30])
        long = [draw.choice(words) for _ in range(3000)]
        at = draw.randrange(2900)
        part, other = " ".join(long[at : at + n]), " ".join(long[at + 2 : at + 2 + n])
        a, b = (P.sketch(shingle_set(t)) for t in (part, other))
        x, y = (set(shingle_set(t).tolist()) for t in (part, other))
        assert P.containment(a, b) == len(x & y) / len(x) and P.resemblance(a, b) == len(x & y) / len(x | y)
        seen.setdefault(n, []).append(P.containment(a, P.sketch(shingle_set(" ".join(long)))))
    assert all(v in (0.0, 1.0) for found in seen.values() for v in found)
    assert sum(seen[30]) / len(seen[30]) > 0.98 and sum(seen[16]) / len(seen[16]) > 0.9


def test_a_very_long_text(spark):
    rows = [(1, "short one"), (2, " ".join(f"l{k}" for k in range(200_000))), (3, "last one here now five six")]
    found = {r["doc_id"]: r for r in P.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[2]["n_chars"] == len(rows[1][1]) and found[2]["near_edited"] > 0.9


def test_merge_is_the_sketch_of_the_union():
    draw = np.random.default_rng(2)
    for n, m in ((1, 1), (1, 50), (3, 400), (500, 500)):
        a, b = (np.unique(draw.integers(0, 2**64, k, dtype=np.uint64)) for k in (n, m))
        found, expected = P.merge(P.sketch(a), P.sketch(b)), P.sketch(np.union1d(a, b))
        assert (found.kept.tolist(), found.whole) == (expected.kept.tolist(), expected.whole)


def test_long_sets_without_a_hash_below_the_threshold():
    """Forty hashes, all above: not taken for a whole set, equal only to itself, and merged as it should be."""
    draw = np.random.default_rng(6)
    high = np.unique(draw.integers(2**62, 2**64, 40, dtype=np.uint64))
    few = np.unique(np.concatenate([high[:1], draw.integers(2**62, 2**64, 9, dtype=np.uint64)]))
    a, b = P.sketch(high), P.sketch(few)
    assert not a.whole and b.whole
    assert (P.likeness(a, a), P.likeness(a, b), P.containment(b, a)) == (1.0, 0.0, 0.0)  # one hash in common; nothing to see of it
    assert not P.parsed(P.fingerprint(a)).whole and P.parsed(P.fingerprint(b)).whole
    assert P.merge(a, b).kept.tolist() == P.sketch(np.union1d(high, few)).kept.tolist() and not P.merge(a, b).whole


def test_written_and_read_back():
    kept = P.sketch(shingle_set("one two three four five six seven eight nine ten"))
    again = P.parsed(P.fingerprint(kept))
    assert (again.kept.tolist(), again.whole) == (kept.kept.tolist(), True)
    assert len(P.parsed("").kept) == 0 and P.fingerprint(P.parsed("")) == ""


def test_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, None), (1, ""), (1, ""), (7, "one two three four five six")], "doc_id long, text string")
    rows = P.compare_with_next(docs).collect()
    assert len(rows) == 5
    assert P.compare_with_next(docs.limit(0)).count() == 0
    alone = P.compare_with_next(docs.filter("doc_id = 7")).first()
    assert (alone["near_next"], alone["n_chars"]) == (1.0, 27)
