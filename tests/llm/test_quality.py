"""Quality classifier and quality rules: by brute force, and on held-out labels."""

import itertools
import random
import zlib

import numpy as np
import pytest

from tendril.llm import quality_classifier as C
from tendril.llm import quality_rules as R


def base(text):
    """The base counts by plain Python."""
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w in windows if windows.count(w) > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def texts():
    draw = random.Random(8)
    words = ["alpha", "béta", "Gamma,", "d|e", "#x", "日本", "e", " nb"]
    made = [draw.choice(["", " ", "\n"]).join([" ".join(draw.choice(words) for _ in range(draw.randint(0, 9))) + draw.choice(["\n", "\r\n", "\t", "\n\n", " "]) for _ in range(draw.randint(0, 12))]) for _ in range(60)]
    return [*made, "", None, "one", "a b c a b c", "same line\nsame line\n \nsame line", "x " * 200, "\n\n\n"]


def test_counts_as_brute_force(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, kept string")
    for r in R.judge(docs, R.DEFAULT).collect():
        expected = base(rows[r["doc_id"]][1])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == expected
        assert r["base_failed"] == (expected[0] < 50 or 100 * expected[4] > 50 * expected[0])
        assert not (r["kept"] and r["base_failed"])


@pytest.mark.parametrize("seed", range(20))
def test_viterbi_as_brute_force(seed):
    draw = np.random.default_rng(seed)
    scores, field = draw.normal(size=draw.integers(1, 9)), R.Field((), *draw.normal(size=2))

    def value(labels):
        out = sum(s for s, c in zip(scores, labels, strict=True) if c)
        return out + sum((field.stay_content if a else field.stay_other) for a, b in itertools.pairwise(labels) if a == b)

    best = max(itertools.product([True, False], repeat=len(scores)), key=value)
    assert value(R.viterbi(scores, field)) == pytest.approx(value(best))


def test_field_learns_to_tell_lines_apart():
    draw = np.random.default_rng(0)
    good = [np.column_stack([np.ones(12), draw.normal(0, 1, 12)]) for _ in range(60)]
    bad = [np.column_stack([np.ones(12), draw.normal(4, 1, 12)]) for _ in range(60)]
    field = R.fit_field(good + bad, [True] * 60 + [False] * 60)
    right = [np.mean(R.viterbi(w @ np.array(field.weights), field)) > 0.5 for w in good] + [np.mean(R.viterbi(w @ np.array(field.weights), field)) < 0.5 for w in bad]
    assert np.mean(right) > 0.97


def test_rules_on_labels(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    rows = R.judge(docs, R.fit(docs, labels)).join(labels, "doc_id").filter("not base_failed").collect()
    clean = [r["kept"] for r in rows if r["quality"] == 1]
    assert np.mean(clean) > 0.95


def made(seed, n_lines, junk):
    draw = random.Random(seed)
    line = lambda: " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 9))) for _ in range(12)) + "."
    bad = lambda: " ".join("CLICK" + draw.choice("ABCDEFGH") + "!!" + str(draw.randint(0, 999)) + "***|" for _ in range(5))
    return "\n".join(bad() if junk else line() for _ in range(n_lines))


def test_sample_is_drawn_from_the_input_with_few_bad_documents(spark):
    # as after the classifier: 3000 bad labels, of which three documents are in the input; and clean ones labelled bad
    docs = [(k, made(k, 8, False)) for k in range(200)] + [(10_000 + 900 * k, made(k, 14, True)) for k in range(3)]
    labels = [(k, int(k >= 2)) for k in range(200)] + [(10_000 + k, 0) for k in range(3000)]
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    field = R.fit(docs, labels, fit_docs=20)
    assert field != R.DEFAULT
    kept = {r["doc_id"] for r in R.keep(docs, field).collect()}
    assert kept == set(range(200))


def test_all_windows_of_a_sampled_text_teach(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(R, "fit_field", lambda windows, good: seen.append((windows, good)) or R.DEFAULT)
    docs = spark.createDataFrame([(1, made(1, 110, False)), (2, made(2, 7, True)), (3, made(3, 5, True))], "doc_id long, text string")
    R.fit(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    windows, good = seen[0]
    assert sorted(zip(map(len, windows), good)) == [(7, False), (14, True), (48, True), (48, True)]
    assert sum(map(len, windows)) == 117


def test_a_very_long_labelled_text_gives_a_bounded_sample(spark, monkeypatch):
    """Windows are drawn over all of a text, not from its beginning, and only the drawn ones come to the driver."""
    seen = []
    monkeypatch.setattr(R, "fit_field", lambda windows, good: seen.append((windows, good)) or R.DEFAULT)
    long = "\n".join("w " * (1 + k // 4800) for k in range(48_000))  # longer lines further on
    docs = spark.createDataFrame([(1, long), (2, made(2, 96, True))], "doc_id long, text string")
    R.fit(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"), fit_windows=100)
    windows, good = seen[0]
    assert (len(windows), sum(good)) == (102, 100)
    assert len({tuple(w[0]) for w, g in zip(windows, good, strict=True) if g}) >= 8


def test_few_rows_move_the_field_a_little():
    fitted = R.Field((9.0,) * len(R.FEATURES), 4.0, 4.0)
    assert R.blended(fitted, 0) == R.DEFAULT
    assert R.blended(fitted, R.PRIOR_DOCS).stay_content == pytest.approx((4.0 + R.DEFAULT.stay_content) / 2)
    assert R.blended(fitted, 1).weights == pytest.approx(R.DEFAULT.weights, abs=0.2)


def test_keep_carries_columns_and_defined_cases(spark):
    good = "This is a line of ordinary prose that goes on for a while and says something, more or less.\n" + " ".join(f"word{k}" for k in range(60))
    docs = spark.createDataFrame([(1, good, 5, "a"), (1, good, 5, "a"), (2, None, 6, "b"), (3, "", 7, None)], "doc_id long, text string, n_words long, `in_text` string")
    kept = R.keep(docs, R.DEFAULT)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 1]
    empty = docs.limit(0)
    assert R.keep(empty, R.DEFAULT).count() == 0
    assert R.fit(empty, spark.createDataFrame([], "doc_id long, quality int")) == R.DEFAULT


def test_isotonic_as_brute_force():
    draw = np.random.default_rng(3)
    for _ in range(30):
        n = draw.integers(1, 12)
        counts, sums = draw.integers(1, 5, n).astype(float), None
        sums = np.array([draw.integers(0, c + 1) for c in counts], float)
        levels = C.isotonic(sums, counts)
        # max-min formula
        expected = [max(min(sums[a : b + 1].sum() / counts[a : b + 1].sum() for b in range(k, n)) for a in range(k + 1)) for k in range(n)]
        assert levels == pytest.approx(expected)


def test_features_approximate_the_kernel():
    draw = np.random.default_rng(1)
    f, d = len(C.STATISTICS), 20_000
    directions = draw.normal(size=(f, d)) / (C.BANDWIDTH * np.sqrt(f / 4))
    model = C.Model(np.zeros(f), np.ones(f), directions, draw.uniform(0, 2 * np.pi, d), np.zeros(d + 1), np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    x = draw.normal(size=(2, f))
    z = model.features(x)[:, 1:]
    exact = np.exp(-((x[0] - x[1]) ** 2).sum() / (2 * (C.BANDWIDTH * np.sqrt(f / 4)) ** 2))
    assert z[0] @ z[1] == pytest.approx(exact, abs=0.05)


def test_normal_equations_and_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    stats = C.document_statistics(docs)
    model = C.fit(stats, labels)
    rows = C.score(stats, model).join(labels, "doc_id").collect()
    held = [(r["score"], r["quality"]) for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    area = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert area > 0.95
    assert np.mean([s >= 0.5 for s in good]) > 0.97
    # the sums over partitions are those of all rows at once
    taught = [r for r in stats.join(labels, "doc_id").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0]
    x, y = np.array([r["stats"] for r in taught]), np.array([r["quality"] for r in taught], float)
    z = model.features(x)
    w = np.where(y > 0, 0.5 * len(y) / y.sum(), 0.5 * len(y) / (len(y) - y.sum()))
    gram = (z * w[:, None]).T @ z + C.RIDGE * len(y) * np.eye(z.shape[1])
    assert np.linalg.solve(gram, (z * w[:, None]).T @ y) == pytest.approx(model.weights, abs=1e-5)


def test_top_word_counts_the_whole_text():
    at = C.STATISTICS.index("top_word")
    assert C.statistics("some plain opening words " + "buy " * 96)[at] == pytest.approx(96 / 100)
    assert C.statistics("the a b c d e")[at] == pytest.approx(1 / 6)
    assert C.statistics("a b b")[at] == pytest.approx(2 / 3)
    assert C.statistics("")[at] == C.statistics(None)[at] == 0.0
    draw = random.Random(3)
    for _ in range(50):
        words = [draw.choice("abcdefg") for _ in range(draw.randint(1, 60))]
        assert C.statistics(" ".join(words))[at] == pytest.approx(max(words.count(w) for w in words) / len(words))


def test_classifier_defined_cases(spark):
    docs = spark.createDataFrame([(1, "a b", 0.5, "x"), (1, "a b", 0.5, "x"), (2, None, 0.1, "x"), (3, "", None, "x"), (None, "c", 1.0, "x")], "doc_id long, text string, score double, stats string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None)], "doc_id long, quality int")
    stats = C.document_statistics(docs)
    model = C.fit(stats, labels)
    assert [r["score"] for r in C.score(stats, model).collect()] == [0.5] * 5
    kept = C.keep(docs, model)
    assert kept.columns == docs.columns and kept.count() == 5
    assert C.keep(docs.limit(0), model).count() == 0
