import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tendril.llm import packing


def fewest(sizes, capacity):
    """Brute force: the least number of sequences."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def put(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms) if r >= sizes[k]}.values():
            rooms[i] -= sizes[k]
            put(k + 1, rooms)
            rooms[i] += sizes[k]
        rooms.append(capacity - sizes[k])
        put(k + 1, rooms)
        rooms.pop()

    put(0, [])
    return best


@pytest.mark.parametrize("seed", range(25))
def test_as_few_as_brute_force(seed):
    draw = random.Random(seed)
    sizes = [draw.randint(3, 20) for _ in range(draw.randint(1, 10))]
    counts = {k: sizes.count(k) for k in set(sizes)}
    plan = packing.bin_completion(counts, 20, None, None)
    used = {}
    for filling, number in plan:
        assert sum(length * n for length, n in filling) <= 20
        for length, n in filling:
            used[length] = used.get(length, 0) + n * number
    assert used == counts
    assert sum(n for _, n in plan) == fewest(sizes, 20)
    assert packing.lower_bound(counts, 20) <= fewest(sizes, 20) <= sum(n for _, n in packing.bin_completion(counts, 20))


def test_better_than_best_fit():
    """Lengths of a seventh to a half of a sequence, where best-fit leaves gaps."""
    won = 0
    for seed in range(6):
        draw = random.Random(seed)
        counts = {}
        for _ in range(400):
            length = draw.randint(300, 1100)
            counts[length] = counts.get(length, 0) + 1
        plan = packing.bin_completion(counts, max_nodes=1000)
        assert all(sum(k * n for k, n in f) <= 2048 for f, _ in plan)
        found, first = sum(n for _, n in plan), sum(n for _, n in packing.best_fit(counts, 2048))
        assert packing.lower_bound(counts, 2048) <= found <= first
        won += first - found
    assert won >= 6


def test_fillings_are_all_undominated_ones():
    """Against all multisets of a small histogram."""
    from itertools import product

    for seed in range(30):
        draw = random.Random(seed)
        counts = {k: draw.randint(1, 2) for k in draw.sample(range(2, 15), 5)}
        lengths = sorted(counts, reverse=True)
        found = list(packing.fillings(16, counts, lengths))
        waste = [16 - sum(k * n for k, n in f) for f in found]
        assert waste == sorted(waste) and len(set(found)) == len(found)
        room = {}
        for numbers in product(*(range(counts[k] + 1) for k in lengths)):
            total = sum(k * n for k, n in zip(lengths, numbers, strict=True))
            if total <= 16:
                room[tuple((k, n) for k, n in zip(lengths, numbers, strict=True) if n)] = 16 - total

        def replaced(f):
            used = dict(f)
            parts = [k for k, n in f for _ in range(n)]
            sums = {0, *parts, *(a + b for i, a in enumerate(parts) for b in parts[i + 1 :])}
            return any(s <= k <= s + room[f] and counts[k] > used.get(k, 0) and (k > s or k not in used) for s in sums for k in lengths)

        assert set(found) == ({f for f in room if not replaced(f)} or {()})


def test_no_filling_is_dominated_by_one_more_piece():
    counts = {7: 1, 6: 2, 5: 1, 3: 2}
    for filling in packing.fillings(12, counts, [7, 6, 5, 3]):
        left = 12 - sum(length * n for length, n in filling)
        spare = {k: v - dict(filling).get(k, 0) for k, v in counts.items()}
        assert not any(n > 0 and k <= left for k, n in spare.items())


DOCS = [(1, "a short text", "x"), (1, "a short text", "x"), (2, None, "y"), (3, "", None), (4, "word " * 6000, "z"), (None, "no id", "z")]


def packed(spark, rows, schema="doc_id long, text string, sequence_id string"):
    return packing.pack(packing.token_pieces(spark.createDataFrame(rows, schema)))


def test_pieces_and_places(spark):
    rows = packed(spark, DOCS).collect()
    known = packing.encoder(packing.default_vocabulary())
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert len(by_doc[1]) == 2  # repeated rows are packed each
    long = sorted(by_doc[4], key=lambda r: r["piece"])
    tokens = [*known("word " * 6000), 0]
    assert [r["start"] for r in long] == list(np.cumsum([0, *(r["length"] for r in long)]))[:-1]
    assert [t for r in long for t in np.frombuffer(r["ids"], "<u4")] == tokens
    assert all(r["length"] == 2048 for r in long[1:])
    assert [r["length"] for r in by_doc[2] + by_doc[3]] == [1, 1]
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_sequences_hold_their_pieces(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, sequence_id string")
    rows = packing.packed_sequences(docs).collect()
    assert sum(len(r["parts"]) for r in rows) == packing.token_pieces(docs).count()
    assert all(len(r["ids"]) == 4 * r["length"] for r in rows)


def test_columns_of_any_name_are_carried(spark):
    names = ["lo", "hi", "each", "first", "at", "slot_length", "salt", "place", "rank", "before", "row", "count", "_salt", "_row"]
    pieces = packing.token_pieces(spark.createDataFrame(DOCS, "doc_id long, text string, sequence_id string")).drop("ids")
    rows = packing.pack(pieces.withColumns({n: F.lit(n) for n in names}))
    assert rows.columns == [*pieces.columns, *names, "sequence_id", "offset"]
    assert all(r[n] == n for r in rows.collect() for n in names) and rows.count() == pieces.count()


def test_empty(spark):
    assert packed(spark, []).count() == 0


def test_hot_length(spark):
    """A third of all pieces and more have one length."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "one two three").otherwise(F.repeat(F.lit("four "), (F.col("id") % 40 + 1).cast("int"))).alias("text"))
    rows = packing.pack(packing.token_pieces(docs)).select("sequence_id", "offset", "length").collect()
    assert len(rows) == 3000 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 3000
    assert len({r["sequence_id"] for r in rows}) == -(-sum(r["length"] for r in rows) // 2048)


def test_same_ids_as_the_other_file():
    import public_tokenizers

    slow, fast = packing.encoder(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder(packing.default_vocabulary())
    for text in ("a <|endoftext|> b", "<|endoftext|><|endoftext|>x", "<|endoftext", "x<|endoftext|>", "", " a  b\n\tc ", "naïve Größe 12345 don't", "日本語 é", "<|endoftext|>", "a" * 500):
        assert slow(text) == fast(text)


