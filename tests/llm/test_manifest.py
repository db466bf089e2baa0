import hashlib
import random
import zlib

import pytest

from tendril.llm import manifest

FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def up(nodes):
    return [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]


def beside(nodes, at):
    """(left, right) of each level for the node at a place, and the root."""
    sides = []
    while len(nodes) > 1:
        run = nodes[at // 16 * 16 : at // 16 * 16 + 16]
        sides.append(("".join(run[: at % 16]), "".join(run[at % 16 + 1 :])))
        nodes, at = up(nodes), at // 16
    return sides, nodes[0]


def altered(row):
    doc_id, source, lang, n_chars, text = row
    if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return doc_id, source, lang, n_chars, text


def brute(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    subroots = [beside([leaf(r) for r in trees[s]], 0)[1] for s in sources]
    out = []
    for k, s in enumerate(sources):
        outer, root = beside(subroots, k)
        digests = [leaf(r) for r in trees[s]]
        for at, row in enumerate(trees[s]):
            sides = [*beside(digests, at)[0], *outer]
            folded = leaf(altered(row))
            for left, right in sides:
                folded = h(left, folded, right)
            out.append((row[0], digests[at], subroots[k], root, h(*(x for side in sides for x in side)), folded, folded == root))
    return sorted(out, key=str)


def corpus(seed, sizes):
    draw = random.Random(seed)
    rows = []
    for s, n in sizes.items():
        rows += [(draw.choice([len(rows) + k, None]) if draw.random() < 0.05 else len(rows) + k, s, draw.choice(["en", None]), draw.choice([None, 5]), draw.choice([None, "", "Ein Straße", "plain", f"Text {k}"])) for k in range(n)]
    draw.shuffle(rows)
    return rows


def found(spark, rows, parts=3):
    df = manifest.manifest(spark.createDataFrame(rows, FIELDS).repartition(parts))
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_as_brute_force(spark, seed):
    rows = corpus(seed, [{"a": 1, None: 17, "b": 40, "ä": 16}, {f"s{k}": 1 + k % 3 for k in range(40)}, {None: 300, "z": 2}][seed])
    assert found(spark, rows) == brute(rows)


def test_many_blocks_and_many_sources(spark):
    """A source of three blocks, and so many sources that the tree over them has several blocks too."""
    rows = [(k, "hot" if k % 2 else f"s{k % 5000:04d}", "en", 4, f"Text {k}") for k in range(20_000)]
    assert found(spark, rows) == brute(rows)


def test_only_tampered_rows_fail(spark):
    rows = [(k, "s", "en", 4, "ABC" if k % 2 else "abc") for k in range(200)]
    assert {r[0] for r in found(spark, rows) if not r[6]} == {k for k in range(200) if k % 2 and zlib.crc32(str(k).encode()) % 5 == 0}


def test_repeats_empty_table_and_other_columns(spark):
    rows = [(1, "a", "en", 1, "x")] * 40 + [(1, "a", "en", 1, "y"), (None, None, None, None, None)]
    assert found(spark, rows) == brute(rows)
    assert manifest.manifest(spark.createDataFrame([], FIELDS)).count() == 0
    wide = spark.createDataFrame([(*r, 3, "q") for r in rows], FIELDS + ", grp int, pos string")
    assert sorted((tuple(r) for r in manifest.manifest(wide).collect()), key=str) == brute(rows)


def test_very_long_text(spark):
    rows = [(k, "a", "en", 1, "AbC é" * 400_000) for k in range(3)]
    assert found(spark, rows) == brute(rows)
