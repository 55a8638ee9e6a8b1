"""Licenses whose wordings differ by one word are told apart."""

import random

import pytest

from trajmill.llm import licenses

OWN = [licenses.Template(name, text, licenses.COVERAGE) for name, texts in licenses.TEMPLATES.items() for text in texts]
NOTICE = "you can redistribute it and/or modify it under the terms of the GNU %s as published by the Free Software Foundation, either version %s of the License, or (at your option) any later version."


@pytest.mark.parametrize(("text", "want"), [
    ("Licensed under CC BY 4.0", {"CC-BY-4.0"}), ("Licensed under CC BY-NC 4.0", {"CC-BY-NC-4.0"}), ("Released under the BSD License", set()),
    ("It is released under the same license.", set()), ("This work is licensed under the GNU General Public License, version 2.", {"GPL-2.0"}),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", {"LGPL-3.0"}), ("This file is licensed under the GNU General Public License, version 3.", {"GPL-3.0"}),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", {"CC-BY-SA-4.0"}), ("Licensed under the Apache License, Version 1.1.", set()),
    ("This program is free software: " + NOTICE % ("General Public License", "2"), {"GPL-2.0"}), ("This program is free software: " + NOTICE % ("Lesser General Public License", "3"), {"LGPL-3.0"}),
    ("This program is free software: " + NOTICE % ("General Public License", "3"), {"GPL-3.0"}), *[(t, {n}) for n, ts in licenses.TEMPLATES.items() for t in ts],
])
def test_names_count(text, want):
    assert {m[0] for m in licenses.scan("Some words before. " + text + " Some words after.", OWN, licenses.COVERAGE)} == want


LONG = [t for t in OWN if len(t.words) > 16]
SHORT = [t for t in OWN if len(t.words) <= 16]


def best_coverage(template, region):
    """The longest common subsequence by plain dynamic programming."""
    row = [0] * (len(region) + 1)
    for w in template.words:
        last = 0
        for j, x in enumerate(region, 1):
            last, row[j] = row[j], last + 1 if w == x else max(row[j], row[j - 1])
    return row[-1] / len(template.words)


def edited(rng, words, share):
    out = []
    for w in words:
        kind = rng.random()
        if kind < share / 3:
            continue
        if kind < 2 * share / 3:
            out.append(f"zz{rng.randint(0, 50)}")
        elif kind < share:
            out += [w, f"zz{rng.randint(0, 50)}"]
        else:
            out.append(w)
    return out


@pytest.mark.parametrize("share", [0.05, 0.1, 0.19])
def test_recall_of_edited_texts(share):
    """Of wordings with edits, all that a brute-force alignment finds to be covered well enough, but for their names, are found."""
    rng, due, got, extra = random.Random(3), 0, 0, 0
    filler = [f"word{i}" for i in range(300)] + ["the", "of", "and", "software", "license", "any", "this"] * 20
    for i in range(120):
        t = LONG[i % len(LONG)]
        region = edited(rng, t.words, share)
        text = [rng.choice(filler) for _ in range(rng.randint(0, 200))] + region + [rng.choice(filler) for _ in range(rng.randint(0, 200))]
        named = all(any(region[j : j + n] == t.words[a : a + n] for j in range(len(region))) for a, n in t.names)
        hits = licenses.scan(" ".join(text), OWN, licenses.COVERAGE)
        if named and best_coverage(t, region) >= licenses.COVERAGE + 0.01:
            due += 1
            got += any(h[0] == t.name for h in hits)
        elif best_coverage(t, region) < licenses.COVERAGE - 0.05:
            extra += any(h[0] == t.name and h[1] < licenses.COVERAGE for h in hits)
    assert got >= 0.98 * due and due > 40 and not extra


def test_recall_of_edited_notices():
    """Short notices with one or two words changed, left out or added that stay covered well enough and keep their names are found, by alignment."""
    rng, due, got = random.Random(9), 0, 0
    for i in range(1200):
        t = SHORT[i % len(SHORT)]
        words = list(t.words)
        for _ in range(rng.choice([1, 2])):
            at = rng.randrange(len(words))
            kind = rng.randrange(3)
            words[at : at + 1] = [] if kind == 0 else [f"zz{i}"] if kind == 1 else [words[at], f"zz{i}"]
        named = all(any(words[j : j + n] == t.words[a : a + n] for j in range(len(words))) for a, n in t.names)
        hits = licenses.scan(" ".join(["some", "words", "before", *words, "and", "after"]), OWN, licenses.COVERAGE)
        if named and best_coverage(t, words) >= licenses.COVERAGE:
            due += 1
            got += any(h[0] == t.name for h in hits)
        elif not named:
            assert all(h[0] != t.name or h[1] >= licenses.COVERAGE for h in hits)
    assert due > 200 and got >= 0.97 * due


def test_short_notices_are_aligned(monkeypatch):
    calls, align = [], licenses.align
    monkeypatch.setattr(licenses, "align", lambda a, b: calls.append(1) or align(a, b))
    for t in SHORT:
        calls.clear()
        assert t.name in {m[0] for m in licenses.scan("x y " + " ".join(t.words) + " z", OWN, licenses.COVERAGE)} and calls


@pytest.mark.parametrize("text", [
    "Released under the XYZ License.", "GNU General Public License, version 4", "CC BY 3.0", "Licensed under CC BY-ND 4.0", "Creative Commons Attribution 3.0 International", "the license was released under the rule of MIT, not by a License", "a version 2 of the public license of the gnu general",
    "Creative Commons Attribution-NoDerivatives 4.0 International", "Licensed under the Apache License, Version 1.0", "public license version 3 for general gnu",
])
def test_wrong_names_are_refused(text):
    assert not licenses.scan(text, OWN, licenses.COVERAGE)


def test_large_gaps_without_anchors():
    """No word is unique in a gap of 90,000 cells, and it is aligned all the same."""
    words = [f"w{i % 60}" for i in range(300)]
    t = licenses.Template("own", " ".join(words), licenses.COVERAGE)
    region = [w if i % 10 else "other" for i, w in enumerate(words)]
    assert [m[:2] for m in licenses.scan(" ".join(region), [t], licenses.COVERAGE)] == [("own", 0.9)]


def test_overlapping_matches_of_equal_worth():
    """Of equal matches that overlap the first in the text counts, of two at one place the first by name."""
    one, two = licenses.Template("B", "alpha beta gamma", 1.0), licenses.Template("A", "gamma delta alpha", 1.0)
    assert [m[0] for m in licenses.scan("alpha beta gamma delta alpha", [one, two], 1.0)] == ["B"]
    assert [m[0] for m in licenses.scan("alpha beta gamma", [one, licenses.Template("A", "alpha beta gamma", 1.0)], 1.0)] == ["A"]


def test_copies_one_after_the_other():
    for t in LONG:
        assert [m[0] for m in licenses.scan(" ".join(t.words * 3), [t], licenses.COVERAGE)] == [t.name] * 3


def test_common():
    rng = random.Random(1)
    for _ in range(100):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        pairs = licenses.common(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x < y and v < w for (x, v), (y, w) in zip(pairs, pairs[1:]))
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        assert len(pairs) == row[-1]
