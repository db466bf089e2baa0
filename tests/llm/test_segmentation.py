from collections import Counter

import numpy as np
import pytest

from tendril.llm import segmentation as S

K = S.vocabulary(S.default_model())


def keys(n, seed=0):
    return S.mix(np.arange(n).astype(np.uint64) ^ np.uint64(seed))


def all_segmentations(text, alpha):
    """Brute force: every way to spell the text, with its chance."""
    pieces = {K.model.id_to_piece(i): (i, K.weights[i]) for i in range(K.model.get_piece_size()) if K.spelled[i] and not K.model.is_byte(i)}
    marked = S.MARK + text.replace(" ", S.MARK)
    found = []

    def walk(at, ids, weight):
        if at == len(marked):
            found.append((tuple(ids), weight))
        for end in range(at + 1, min(len(marked), at + K.longest) + 1):
            if marked[at:end] in pieces:
                i, w = pieces[marked[at:end]]
                walk(end, [*ids, i], weight + alpha * w)

    walk(0, [], 0.0)
    total = np.log(sum(np.exp(w) for _, w in found))
    return {ids: np.exp(w - total) for ids, w in found}


@pytest.mark.parametrize("text", ["abc", "a bc", "the end"])
def test_chances_as_brute_force(text):
    expected = all_segmentations(text, 0.5)
    drawn = S.sampled([text] * 4000, keys(4000), K, 2, 0.5)
    first = Counter(tuple(x[0][1].tolist()) for x in drawn)
    for each in drawn:
        ids = [tuple(i.tolist()) for _, i in each]
        assert len(set(ids)) == 2  # without replacement
        for (x, _), i in zip(each, ids, strict=True):
            assert np.exp(x.log_prob) == pytest.approx(expected[i], rel=1e-6)
        assert each[0][0].perturbed >= each[1][0].perturbed
    for ids, chance in expected.items():
        assert first[ids] / 4000 == pytest.approx(chance, abs=0.04)
    among = Counter(i for each in drawn for i in {tuple(x[1].tolist()) for x in each})
    for ids, p in expected.items():
        inclusion = p + sum(q * p / (1 - q) for other, q in expected.items() if other != ids)
        assert among[ids] / 4000 == pytest.approx(inclusion, abs=0.04)


def test_all_segmentations_if_there_are_few():
    [found] = S.sampled(["x"], keys(1), K, 5, 1.0)
    assert {tuple(i.tolist()) for _, i in found} == set(all_segmentations("x", 1.0))
    assert all(x.log_inclusion == 0 for x, _ in found)


def test_inclusion_scores_estimate_sums():
    """Horvitz-Thompson: the sum of p / q over samples is 1 on average."""
    sums = [sum(np.exp(x.log_prob - x.log_inclusion) for x, _ in each) for each in S.sampled(["abcde"] * 3000, keys(3000, 9), K, 3, 0.5)]
    assert np.mean(sums) == pytest.approx(1.0, abs=0.05)


TEXTS = ["", "Hello world", " hi  there\nnew\tline ", "日本語 é 👩‍👩‍👧", "\x00\x01", "x" * 3000, "a" + " " * 50 + "b", "word " * 400]


def test_samples_depend_on_the_row_alone():
    together = S.sampled(TEXTS, keys(len(TEXTS)), K, 3, 1.0)
    for k, text in enumerate(TEXTS):
        S._STORES.clear()
        [alone] = S.sampled([text], keys(len(TEXTS))[k : k + 1], K, 3, 1.0)
        assert [i.tolist() for _, i in alone] == [i.tolist() for _, i in together[k]]
        assert [x.perturbed for x, _ in alone] == pytest.approx([x.perturbed for x, _ in together[k]])


def test_round_trip(spark):
    rows = [(k, t, "clash") for k, t in enumerate(TEXTS)] + [(None, None, None), (1, TEXTS[1], "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    drawn = S.sample(docs)
    back = S.decode(drawn, ("doc_id", "sample")).collect()
    for r in back:
        assert r["text"] == ("" if r["doc_id"] is None else TEXTS[r["doc_id"]])
    per_row = Counter(r["doc_id"] for r in back)
    assert per_row[None] == 1 and per_row[0] == 1 and per_row[1] == 6
    same = S.sample(docs, with_text=True).collect()
    assert sorted((str(r["doc_id"]), r["sample"], r["text"]) for r in same) == sorted((str(r["doc_id"]), r["sample"], r["text"]) for r in back)
    plain = {r["doc_id"]: r["text"] for r in S.decode(S.encode(docs)).collect()}
    assert plain[2] == TEXTS[2]
    assert S.sample(docs.limit(0)).count() == 0


def test_texts_take_their_next_nodes_together(monkeypatch):
    calls = Counter()
    for name in ("below", "logs"):
        monkeypatch.setattr(S, name, lambda *args, _name=name, _own=getattr(S, name): (calls.update([_name]), _own(*args))[1])

    def called(n):
        calls.clear()
        S._STORES.clear()
        assert [len(x) for x in S.sampled(["a word of some length"] * n, keys(n), K, 3, 1.0)] == [3] * n
        return dict(calls)

    assert called(200) == called(2)


def test_ids_are_spelled_together():
    ids = [K.model.encode(t) for t in TEXTS]
    assert S.decoded([np.array(x, "<u4") for x in ids], K) == TEXTS
    assert S.decoded([], K) == [] and S.decoded([np.zeros(0, "<u4")], K) == [""]
    broken = np.array([K.bytes[0x20], K.bytes[0xE6], K.bytes[0x97]], "<u4")  # a cut character
    assert S.decoded([broken, np.zeros(0, "<u4"), broken[:1]], K) == ["�", "", ""]
