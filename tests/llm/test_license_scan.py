import random
from itertools import combinations

import pytest
from odd_rows import documents, no_documents

from receivables.llm import license_scan as L
from receivables.llm import queries


@pytest.mark.parametrize("seed", range(30))
def test_longest_rising_by_hand(seed):
    rng = random.Random(seed)
    values = [rng.randrange(10) for _ in range(rng.randrange(9))]
    places = L.longest_rising(values)
    picked = [values[i] for i in places]
    assert places == sorted(places) and all(a < b for a, b in zip(picked, picked[1:]))
    best = max(
        n
        for n in range(len(values) + 1)
        if any(all(a < b for a, b in zip(c, c[1:])) for c in combinations(values, n))
    )
    assert len(places) == best


@pytest.mark.parametrize("seed", range(30))
def test_alignments_are_common_subsequences(seed):
    rng = random.Random(seed)
    a, b = ([rng.choice("abcdefghij") for _ in range(rng.randrange(25))] for _ in range(2))
    pairs = L.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))
    assert len(pairs) <= len(L._common(a, b))
    assert len(L.align(a, a)) == len(a)


def test_common_subsequence_by_hand():
    assert len(L._common(list("abcbdab"), list("bdcaba"))) == 4


def spoil(rng, words, share):
    """The words with a share of them replaced, dropped or followed by another."""
    out = []
    for word in words:
        if rng.random() < share:
            out += rng.choice([[], ["other"], [word, "more"]])
        else:
            out.append(word)
    return out


@pytest.mark.parametrize("name", sorted(L.TEMPLATES))
def test_copies_are_found(name):
    scanner, rng = L.Scanner(L.TEMPLATES), random.Random(name)
    words = L.words_of(L.TEMPLATES[name])
    around = [f"w{i}" for i in range(50)]
    text = " ".join(around + words + around + [w.upper() for w in words] + around)
    found = {n: (c, s) for n, c, s in scanner.scan(text)}
    n = len(words)
    assert found[name] == (1.0, [(50, 50 + n), (100 + n, 100 + 2 * n)])
    if n >= 40:
        text = " ".join(around + spoil(rng, words, 0.08) + around)
        assert name in {n for n, _, _ in scanner.scan(text)}
        half = " ".join(around + words[: n // 2] + around)
        assert name not in {n for n, _, _ in scanner.scan(half)}


def test_no_notice():
    scanner = L.Scanner(L.TEMPLATES)
    for text in (None, "", "license " * 3000, "under the terms of the treaty " * 500, "x" * 100_000):
        assert scanner.scan(text) == []


def test_copies_with_words_between():
    scanner = L.Scanner(L.TEMPLATES)
    around = " ".join(f"w{i}" for i in range(10))
    for line, name in (
        ("Released under the terms of the MIT License", "MIT"),
        ("Licensed under the terms of the Apache License, Version 2.0", "Apache-2.0"),
    ):
        n = len(L.words_of(line))
        found = {name: (c, s) for name, c, s in scanner.scan(f"{around} {line}. {around} {line}")}
        assert found[name] == (1.0, [(10, 10 + n), (20 + n, 20 + 2 * n)])
    for name in ("MIT-grant", "Apache-2.0-notice", "GPL-3.0-notice"):
        words = L.words_of(L.TEMPLATES[name])
        text = " ".join(f"{word} x y z" if i % 4 == 0 else word for i, word in enumerate(words))
        found = {name: (c, len(s)) for name, c, s in scanner.scan(f"{around} {text} {around} {' '.join(words)}")}
        assert found[name] == (1.0, 2)
    far = " ".join(f"{word} {around}" for word in L.words_of(L.TEMPLATES["MIT"]))
    assert scanner.scan(far) == []


NEAR = {
    "Released under the BSD License": {"BSD"},
    "Released under the BSD 3-Clause License": {"BSD-3-Clause"},
    "Released under the ISC License": {"ISC"},
    "Licensed under the Mozilla Public License, Version 2.0": {"MPL-2.0"},
    "Licensed under the Apache License, Version 1.1": set(),
    "Licensed under CC BY 4.0": {"CC-BY-4.0"},
    "Licensed under CC BY-SA 4.0": {"CC-BY-SA-4.0"},
    "Licensed under CC BY-NC-SA 3.0": {"CC-BY-NC-SA-3.0"},
    "Licensed under CC BY-NC 4.0": {"CC-BY-NC-4.0"},
    "Licensed under CC BY-NC 1.0": set(),
    "This work is licensed under the GNU General Public License, version 2": {"GPL-2.0"},
    "This work is licensed under the GNU General Public License, version 3": {"GPL-3.0"},
    "Licensed under the GNU General Public License, version 3": {"GPL-3.0-short"},
    "This work is licensed under the GNU Lesser General Public License, version 3": {"LGPL-3.0"},
    "This work is licensed under the GNU Library General Public License, version 2": set(),
    "This work is licensed under the GNU Affero General Public License, version 3": {"AGPL-3.0"},
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": {
        "CC-BY-SA-4.0-notice"
    },
    "Released under CC0 1.0 Universal": {"CC0-1.0"},
    "Released under the Unlicense": {"Unlicense"},
    "Released under the X License": set(),
    "MIT License": {"MIT-header"},
    "Copyright (c) 2020 The MIT License (MIT)": {"MIT-header"},
    "Apache License Version 2.0, January 2004": {"Apache-2.0-header"},
    "SPDX-License-Identifier: MIT": {"MIT-spdx"},
    "SPDX-License-Identifier: GPL-3.0-or-later": {"GPL-3.0-spdx-later"},
    "SPDX-License-Identifier: GPL-2.0-only": {"GPL-2.0-spdx-only"},
    "SPDX-License-Identifier: BSD-3-Clause": {"BSD-3-Clause-spdx"},
    "SPDX-License-Identifier: LicenseRef-X": set(),
    "Licensed under Apache 2.0": {"Apache-2.0-named"},
    "Licensed under the Eclipse Public License, Version 2.0": {"EPL-2.0-named"},
    "Licensed under the EUPL, Version 1.2": {"EUPL-1.2-named"},
    "Released under the zlib License": {"Zlib-named"},
    "Licensed under the MIT License or the Apache License, Version 2.0": {"MIT", "Apache-2.0"},
}


@pytest.mark.parametrize("line", sorted(NEAR))
def test_near_misses(line):
    found = {name for name, _, _ in L.Scanner(L.TEMPLATES).scan(f"Some words. {line}. And more words.")}
    assert found == NEAR[line]


def test_the_best_notice_is_given():
    scanner = L.Scanner(L.TEMPLATES)
    for name in sorted(L.TEMPLATES):
        assert [(n, c) for n, c, _ in scanner.scan(L.TEMPLATES[name])] == [(name, 1.0)]


def test_odd_rows(spark):
    assert L.scan_licenses(documents(spark)).count() == 0
    rows = [(1, "All rights reserved."), (None, "ALL RIGHTS, RESERVED!"), (1, "All rights reserved.")]
    found = L.scan_licenses(documents(spark, rows)).collect()
    assert found[0].__fields__ == ["doc_id", "license", "template", "coverage", "n_copies", "spans"]
    assert [(r.license, r.coverage, r.n_copies) for r in found] == [("all-rights-reserved", 1.0, 1)] * 3
    assert L.scan_licenses(no_documents(spark)).count() == 0
    own = L.scan_licenses(documents(spark), {"cat": "the cat sat on the mat", "none": "..."})
    assert sorted((r.doc_id, r.license, r.n_copies) for r in own.collect()) == [
        (1, "cat", 5),
        (7, "cat", 5),
    ]


def test_query_finds_the_planted_lines(spark):
    sf_dir = "/root/testdata/sf0.01"
    lines = [L.TEMPLATES[n] for n in ("Apache-2.0", "MIT", "GPL-3.0", "CC-BY-NC-4.0", "all-rights-reserved")]
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    names = {text: name for name, text in L.TEMPLATES.items()}
    expected = {(row.doc_id, names[line]) for row in texts for line in lines if line in row.text}
    found = queries.op10_license_scan(spark, sf_dir).collect()
    assert expected and expected <= {(row.doc_id, row.template) for row in found}
    assert {(r.doc_id, r.template) for r in found if r.coverage == 1} == expected
    assert all(r.license == L.license_of(r.template) for r in found)


def test_one_name_a_license():
    assert {L.license_of(name) for name in L.TEMPLATES if name.startswith(("GPL-3", "MIT"))} == {"GPL-3.0", "MIT"}
    assert {L.license_of(name) for name in L.TEMPLATES if "BSD-3" in name} == {"BSD-3-Clause"}
    assert L.license_of("own-notice") == "own-notice"


def whole_copies(words, template, needed):
    """Brute force over all starts: the stretches of as many words as the template that share a
    common subsequence of ``needed`` words or more with it, begun by a word matched."""
    n = len(template)
    found = []
    for start in range(len(words)):
        pairs = L._common(words[start : start + n + 1], template)
        if len(pairs) >= needed and pairs[0][0] == 0:
            found.append((start, start + pairs[-1][0] + 1))
    return found


@pytest.mark.parametrize("seed", range(12))
def test_copies_against_all_starts(seed):
    """On random texts a copy is found wherever some start holds one, and nowhere else."""
    rng = random.Random(seed)
    template = [rng.choice("abcdefghijklmnop") + str(i % 3) for i in range(rng.randrange(6, 16))]
    scanner = L.Scanner({"t": " ".join(template)})
    for _ in range(25):
        words = []
        for _ in range(rng.randrange(1, 4)):
            words += [f"z{rng.randrange(9)}" for _ in range(rng.randrange(20, 30))]
            copy = list(template)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = "other"
            words += copy
        words += [f"z{rng.randrange(9)}" for _ in range(20)]
        spans = [span for _, _, spans in scanner.scan(" ".join(words)) for span in spans]
        every = whole_copies(words, template, scanner.needed("t"))
        for first, behind in every:
            assert any(a < behind and first < b for a, b in spans), (words, every, spans)
        for a, b in spans:
            assert any(a < behind and first < b for first, behind in every), (words, every, spans)
