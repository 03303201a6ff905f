import random

import numpy as np
import pytest

from lenscube.llm import licenses
from lenscube.llm.decontamination import words_of


def brute(text):
    def grams(t):
        w = words_of(t)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    own = grams(text)
    held = {k: len(g & own) / len(g) for k, (_, t, _) in enumerate(licenses.TEMPLATES) if len((g := grams(t)) & own) >= 0.8 * len(g)}
    family = lambda k: licenses.TEMPLATES[k][2]
    return {k: c for k, c in held.items() if c == max(x for j, x in held.items() if family(j) == family(k))}


def test_equals_brute_force(spark):
    r = random.Random(2)
    noise = lambda n: " ".join(r.choice(["lorem", "the", "license", "under", "of", "ça"]) for _ in range(n))
    texts = [None, "", "Released under the MIT", noise(30_000)]
    for _, t, _ in licenses.TEMPLATES:
        w = t.split()
        texts += [f"{noise(r.randint(0, 90))} {t.upper()} {noise(r.randint(0, 400))}", t]
        if len(w) > 40:
            w[3] = "changed"
            texts += [f"{noise(7)} {' '.join(w)}", " ".join(w[: len(w) // 2])]
    rows = [(i, t, "m") for i, t in enumerate(texts)] + [(4, texts[4], "m")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, matches string")).collect()
    assert sorted((x.doc_id, sorted((m.template, round(m.containment, 9)) for m in x.matches)) for x in got) == sorted(
        (i, sorted((k, round(c, 9)) for k, c in brute(t).items())) for i, t, _ in rows
    )
    assert licenses.report(licenses.scan(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_variants_of_a_family_are_told_apart(spark):
    short = "This work is licensed under the GNU {} License, version {}."
    long = "This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {} License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    names = [
        ("GPL-3.0", "program", "General Public", "3"), ("GPL-2.0", "program", "General Public", "2"), ("AGPL-3.0", "program", "Affero General Public", "3"),
        ("LGPL-3.0", "library", "Lesser General Public", "3"), ("LGPL-2.1", "library", "Lesser General Public", "2.1"),
    ]
    cases = [(n, short.format(who, v)) for n, _, who, v in names] + [(n, long.format(what, who, v)) for n, what, who, v in names]
    cases += [("GPL-2.0,GPL-3.0", f"{cases[0][1]} lorem ipsum {cases[1][1]}"), ("AGPL-3.0,GPL-3.0", f"{cases[0][1]} lorem ipsum {cases[7][1]}")]
    cases += [("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.")]
    docs = [(i, f"lorem ipsum dolor {t} sit amet consectetur") for i, (_, t) in enumerate(cases)]
    got = licenses.report(licenses.scan(spark.createDataFrame(docs, "doc_id long, text string"))).collect()
    assert {x.doc_id: x.licenses for x in got} == {i: n for i, (n, _) in enumerate(cases)}


def test_many_templates_and_short_ones():
    r = random.Random(6)
    texts = [" ".join(r.choice("abcdefghij") + str(r.randint(0, 99)) for _ in range(r.randint(5, 400))) for _ in range(200)]
    index = licenses.Index([(str(k), t) for k, t in enumerate(texts)])
    docs = [f"x y z {texts[k]} z y x {texts[-1 - k]}" for k in range(0, 100, 3)]
    got = index.matches([licenses.shingles(words_of(t)) for t in docs])
    want = [{str(k), str(199 - k)} for k in range(0, 100, 3)]
    assert sum({n for n, _, _ in g} == w for g, w in zip(got, want)) >= 33 and all({n for n, _, _ in g} <= w for g, w in zip(got, want))
    assert index.retrieve([licenses.shingles(words_of("nothing of the kind at all is here")), np.zeros(0, np.uint64)]) == set()
    with pytest.raises(ValueError, match="fewer than 5"):
        licenses.Index([("s", "only four words here")])


def test_windows_stay_within_a_document():
    r = np.random.default_rng(4)
    sizes = np.array([1, 7, 8, 9, 40])
    values = r.integers(0, 1 << 60, sizes.sum(), dtype=np.uint64)
    ends = np.cumsum(sizes)
    for width, doc, least in licenses.Windows(sizes, [4, 16, 32]).minima(values):
        want = [(d, values[b + k : min(b + k + 2 * width, e)].min()) for d, (b, e) in enumerate(zip(ends - sizes, ends)) for k in range(0, e - b, width)]
        assert list(zip(doc.tolist(), least.tolist())) == [(d, int(v)) for d, v in want]


def test_bands_find_what_they_promise():
    r = np.random.default_rng(3)
    index = licenses.Index([("x", " ".join(f"t{i}" for i in range(13)))])  # 9 shingles, class of 16: the hardest case
    missed = 0
    for _ in range(300):
        words = [b"w%d" % i for i in r.integers(0, 1 << 30, 200)]
        at = int(r.integers(0, 180))
        words[at : at + 13] = [b"t%d" % i for i in range(13)]
        missed += not index.matches([licenses.shingles(words)])[0]
    assert missed <= 3
