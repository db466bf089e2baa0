import hashlib
import random

import numpy as np
import pytest

from tendril.llm import clustering

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows):
    """The same in Python integers."""
    kept = []
    for vec_id, vector in rows:
        if vector is not None and len(vector) == 64 and all(x is not None and np.isfinite(np.float32(x)) for x in vector):
            kept.append((vec_id, [int(np.floor(float(np.float32(x)) * 256)) for x in vector]))
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:40]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))

    for _ in range(5):
        own = [nearest(v)[1] for _, v in kept]
        for k in range(len(centroids)):
            members = [v for (_, v), c in zip(kept, own) if c == k]
            if members:
                centroids[k] = [sum(x) // len(members) for x in zip(*members)]
    last = [nearest(v) for _, v in kept]
    inertia = [sum(d for d, c in last if c == k) for k in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia), digest[c]) for (i, _), (d, c) in zip(kept, last)), key=str)


def found(spark, rows, schema=SCHEMA):
    return sorted((tuple(r) for r in clustering.cluster(spark.createDataFrame(rows, schema).repartition(3)).collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_as_brute_force(spark, seed):
    """Few different components, so that ties abound; large ones, which float32 cannot tell apart; plain ones."""
    draw = random.Random(seed)
    component = [lambda: draw.choice([-1.0, 0.0, 0.25, 1.0]), lambda: 100_000 + draw.choice([0.0, 0.0078125, 0.015625]), lambda: draw.gauss(0, 1)][seed]
    rows = [(k, [component() for _ in range(64)]) for k in range(150)]
    rows += rows[:5] + [(7, rows[9][1]), (None, rows[3][1]), (200, None), (201, [1.0] * 63), (202, [1.0] * 65), (203, [None] + [1.0] * 63), (204, [float("nan")] * 64), (205, [float("inf")] + [0.0] * 63), (206, [])]
    assert found(spark, rows) == brute(rows)


def test_few_vectors_none_and_other_columns(spark):
    rows = [(k, [float(k)] * 64) for k in range(5)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    assert found(spark, [(1, None)]) == []
    wide = [(*r, 4, "x") for r in rows]
    assert found(spark, wide, SCHEMA + ", cluster int, vector string") == brute(rows)


def test_too_large_components_are_left_out(spark):
    rows = [(1, [524_287.0] * 64), (2, [-524_287.0] * 64), (3, [524_288.0] + [0.0] * 63), (4, [3e38] * 64)]
    assert [r[0] for r in found(spark, rows)] == [1, 2]


def test_intervals_hold_the_exact_value_and_screen_nearly_all():
    draw = np.random.default_rng(1)
    for top in (3, 300, 1 << 20, (1 << 27) - 1):
        vectors, centroids = draw.integers(-top, top + 1, (400, 64)), draw.integers(-top, top + 1, (40, 64))
        low, high = clustering.screened(vectors, centroids)
        exact = np.array([[int(c @ c) - 2 * sum(int(a) * int(b) for a, b in zip(v, c)) for c in centroids] for v in vectors[:40]], object)
        assert (low[:40] <= exact).all() and (exact <= high[:40]).all()
        nearest, away, left = clustering.assign(vectors, centroids)
        whole = ((vectors[:, None, :] - centroids[None]) ** 2).sum(axis=2)
        assert (nearest == whole.argmin(axis=1)).all() and (away == whole.min(axis=1)).all()
        assert top < 300 or left < 20
