import pytest

from tendril.llm import license_scan as L


@pytest.mark.parametrize("name", sorted(L.TEMPLATES))
def test_templates_find_themselves(name):
    for template in L.TEMPLATES[name]:
        text = f"some words before.\n{template}\nsome words after."
        found = L.scan_text(text)
        assert [(x[2], x[6]) for x in found] == [(name, True)]
        assert text[found[0][0] : found[0][1]].rstrip(".") == template.rstrip(".")


@pytest.mark.parametrize(
    "text, license, confirmed",
    [
        ("Licensed under the Apache License, Version 1.1.", "Apache-2.0", False),
        ("This file is licensed under the Apache License, Version 2.0!", "Apache-2.0", True),
        ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0", True),
        ("Licensed under CC BY-NC-SA 3.0.", "CC-BY-NC-SA-4.0", False),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "CC-BY-NC-ND-4.0", True),
        ("We have licensed under the GPLv3", "GPL-3.0", True),
        ("License: Apache-2.0", "Apache-2.0", True),
        ("This project is MIT licensed.", "MIT", True),
        ("LGPL version 2.1", "LGPL-2.1", True),
        ("Released under the Eclipse Public License 2.0.", "EPL-2.0", True),
        ("A word. İ Licensed under CC BY-SA 4.0. more text", "CC-BY-SA-4.0", True),
    ],
)
def test_versions_and_names_must_agree(text, license, confirmed):
    assert [(x[2], x[6]) for x in L.scan_text(text)] == [(license, confirmed)]


def test_notice_over_several_lines():
    template = L.TEMPLATES["MIT"][1]
    words = template.split(" ")
    text = "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))
    found = L.scan_text("x\n" + text)
    assert any(x[2] == "MIT" for x in found)


def test_ranked_by_saving():
    found = L.ranked("Released under the MIT License.")
    assert found[0][1] == "MIT" and found == sorted(found, key=lambda x: (-x[0], x[1], x[2]))


def test_differences_are_exact():
    listed, share, telling = L.differences("one two four", "one two three four")
    assert (listed, share, telling) == (["-three +"], 0.25, False)


def test_over_a_table(spark):
    rows = [(1, "Released under the MIT License.", "k"), (1, "Released under the MIT License.", "k"), (2, None, "k"), (3, "", None), (4, "nothing", "k"), (None, "All rights reserved.", "k"), (5, "licensed " * 20_000, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string")
    found = L.scan(docs).collect()
    assert sorted((r["doc_id"] or 0, r["confirmed"]) for r in found) == [(0, True), (1, True), (1, True), (5, False)]
    assert L.scan(docs.limit(0)).count() == 0


def test_notice_with_other_notices_around():
    mit, bsd = L.TEMPLATES["MIT"][1], next(t for t in L.TEMPLATES["BSD-3-Clause"] if "AS IS" in t)
    wrapped = lambda t: "\n".join(" ".join(t.split()[k : k + 8]) for k in range(0, len(t.split()), 8))
    text = f"Copyright 2020 Somebody\n\n{wrapped(mit)}\nSee also: licensed under CC BY-SA 4.0.\nLicense files follow.\n{wrapped(bsd)}\nDistributed under GPL v3, or available under CC BY 4.0."
    confirmed = {x[2] for x in L.scan_text(text) if x[6]}
    assert confirmed == {"MIT", "CC-BY-SA-4.0", "BSD-3-Clause", "GPL-3.0", "CC-BY-4.0"}


def test_near_misses_are_told_apart():
    full = {name: max(texts, key=len) for name, texts in L.TEMPLATES.items()}
    for name in ("BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "AGPL-3.0", "BSL-1.0", "ISC", "Zlib"):
        assert {x[2] for x in L.scan_text(full[name]) if x[6]} == {name}
    assert not any(x[6] for x in L.scan_text(full["GPL-3.0"].replace("version 3", "version 4")))


def altered(text, draw, share):
    """A notice with words replaced, dropped and put in, outside the telling ones, wrapped anew."""
    out = []
    for w in text.split():
        if draw.random() < share and not L.telling_words().intersection(L.words(w)):
            out += draw.choice([[], ["other"], [w, "more"]])
        else:
            out.append(w)
    return "".join(w + draw.choice([" ", " ", " ", "\n"]) for w in out)


def test_recall_of_planted_and_altered_notices():
    """Against what was planted: at least 0.9 found with one word in twenty altered, nothing in clean prose."""
    from random import Random

    draw = Random(11)
    prose = lambda n: " ".join(draw.choice("the of and a work person with right use copy to we notice form other any code text under this version free general public".split()) for _ in range(n))
    caught = planted = false = 0
    for name, texts in L.TEMPLATES.items():
        for text in texts:
            if len(L.words(text)) < 8:
                continue
            for _ in range(4):
                planted += 1
                found = {x[2] for x in L.scan_text(f"{prose(40)}. {altered(text, draw, 0.05)} {prose(40)}") if x[6]}
                caught += name in found
                false += bool(found - {name})
    assert caught >= 0.9 * planted and false <= 0.05 * planted
    assert not any(x[6] for _ in range(50) for x in L.scan_text(prose(300)))


def test_windows_as_brute_force():
    """Anchored windows find what a slide of every template over every place finds."""
    from random import Random

    draw = Random(5)
    names = ["MIT", "ISC", "CC0-1.0", "Apache-2.0"]
    some = {n: L.TEMPLATES[n] for n in names}
    for _ in range(6):
        picked = [draw.choice(some[draw.choice(names)]) for _ in range(3)]
        text = " unrelated words stand here. ".join(picked)
        spans = [(m.start(), m.end()) for m in L._WORD.finditer(text)]
        best = []
        for name, texts in some.items():
            for t in texts:
                n = len(L.words(t))
                for k in range(len(spans) - n + 1):
                    if L.words(text[spans[k][0] : spans[k + n - 1][1]]) == L.words(t):
                        best.append((-n, k, k + n, name))
        chosen = []
        for _, a, b, name in sorted(best):
            if all(b <= c or d <= a for c, d, _ in chosen):
                chosen.append((a, b, name))
        assert [x[2] for x in L.windows(text, some)] == [name for _, _, name in sorted(chosen)]


def test_a_very_long_text_of_notices():
    text = " ".join(["Released under the MIT License. Some words between."] * 3000)
    assert sum(x[6] for x in L.windows(text)) == 3000


def test_every_template_passes_the_gate():
    assert all(L.may_hold(t) and L.may_hold(" ".join(t.split()).upper()) for texts in L.TEMPLATES.values() for t in texts)
    assert not L.may_hold("accents and successes")
