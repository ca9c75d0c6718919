"""License notices in documents, by patience alignment with templates.

Words are runs of ASCII letters and digits (and dots between digits) in lower case. A
stretch of a document is aligned with a template on the words that are unique in both:
the longest run of them in the same order anchors the alignment, and the gaps between
anchors are aligned in turn; a gap without such words is settled by the longest common
subsequence. Coverage is the share of the template's words that are matched.

A copy is looked for wherever ``SPAN`` times the template's length of words holds enough of
its words to be covered by ``LEAST_COVERAGE``; a stretch is left out only if no copy of at
most that length can lie in it. Elsewhere the stretch grows, as long as between any two
words matched there are at most ``GAP`` words more than in the template.

The words of a short form that tell its license from others (``NEEDED``: name, terms,
version) must all be matched, and none that makes another license of it (``OTHERWISE``) may
stand between. Where templates share a stretch, the one that matches most words is given.

Results by case: a NULL or empty text has no notice and gives no row; a document gives one
row for each template it covers best somewhere, with the place of every such copy, so
repeated notices are counted; of overlapping copies of one template the first is taken; copies and repeated rows are scanned alike; an
empty table gives an empty one; further columns of the input are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from receivables.llm.common import map_rows, per_worker, share, type_of

LEAST_COVERAGE = 0.8
SPAN = 1.25
GAP = 6
WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")

# The usual short forms of license notices, their usual notices and grants.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
        "file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed "
        "to in writing, software distributed under the License is distributed on an \"AS IS\" "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See "
        "the License for the specific language governing permissions and limitations under the "
        "License."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in "
        "all copies or substantial portions of the Software."
    ),
    "BSD-grant": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met: Redistributions of source "
        "code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the "
        "terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
    "MPL-2.0": "Licensed under the Mozilla Public License, Version 2.0.",
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a "
        "copy of the MPL was not distributed with this file, You can obtain one at "
        "https://mozilla.org/MPL/2.0/."
    ),
    "ISC": "Released under the ISC License.",
    "ISC-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies."
    ),
    "BSD": "Released under the BSD License.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "Unlicense": "Released under the Unlicense.",
    "Unlicense-notice": (
        "This is free and unencumbered software released into the public domain. Anyone is free to "
        "copy, modify, publish, use, compile, sell, or distribute this software, either in source "
        "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by "
        "any means."
    ),
    "CC0-1.0": "Released under CC0 1.0 Universal.",
}
# The words of a short form that must all be matched: what tells a license from others.
NEEDED = {
    "Apache-2.0": "apache 2.0",
    "MIT": "mit",
    "GPL-3.0": "general 3",
    "MPL-2.0": "mozilla 2.0",
    "ISC": "isc",
    "BSD": "bsd",
    "BSD-2-Clause": "bsd 2 clause",
    "BSD-3-Clause": "bsd 3 clause",
    "Unlicense": "unlicense",
    "CC0-1.0": "cc0",
    "all-rights-reserved": "all rights reserved",
}
for _name, _kind, _version, _number in (
    ("GPL-2.0", "", "2", "2"),
    ("GPL-3.0", "", "3", "3"),
    ("LGPL-2.1", "Lesser", "2.1", "2.1"),
    ("LGPL-3.0", "Lesser", "3", "3"),
    ("AGPL-3.0", "Affero", "3", "3"),
):
    _license = " ".join(f"GNU {_kind} General Public License".split())
    _what = "library" if _kind == "Lesser" else "program"
    _short = f"{_name}-short" if _name in TEMPLATES else _name
    TEMPLATES[_short] = f"Licensed under the {_license}, version {_version}."
    NEEDED[_short] = f"{_kind} general {_version}".lower().strip()
    TEMPLATES.setdefault(
        f"{_name}-notice",
        f"This {_what} is free software: you can redistribute it and/or modify it under the terms of "
        f"the {_license} as published by the Free Software Foundation, either version {_version} of "
        "the License, or (at your option) any later version.",
    )
for _terms in ("BY", "BY-SA", "BY-NC", "BY-NC-SA", "BY-ND", "BY-NC-ND"):
    _long = _terms.replace("BY", "Attribution").replace("NC", "NonCommercial")
    _long = _long.replace("SA", "ShareAlike").replace("ND", "NoDerivatives")
    for _version in ("2.0", "2.5", "3.0", "4.0"):
        _name = f"CC-{_terms}-{_version}"
        TEMPLATES[_name] = f"Licensed under CC {_terms} {_version}."
        NEEDED[_name] = f"cc {_terms} {_version}".lower().replace("-", " ")
        TEMPLATES[f"{_name}-notice"] = (
            f"This work is licensed under a Creative Commons {_long} {_version} License."
        )
        NEEDED[f"{_name}-notice"] = f"{_long} {_version}".lower().replace("-", " ")
# License of the templates whose name is not its own: what stands behind it names the template.
KINDS = ("notice", "grant", "short", "header", "named", "spdx", "spdx-only", "spdx-later")
# How licenses are called in headings and in passing, and what must be matched.
for _name, _kind, _text, _must in (
    ("MIT", "header", "MIT License", "mit license"),
    ("ISC", "header", "ISC License", "isc license"),
    ("BSD-2-Clause", "header", "BSD 2-Clause License", "bsd 2 clause license"),
    ("BSD-3-Clause", "header", "BSD 3-Clause License", "bsd 3 clause license"),
    ("Apache-2.0", "header", "Apache License Version 2.0, January 2004", "apache 2.0"),
    ("Apache-2.0", "named", "Licensed under Apache 2.0", "apache 2.0"),
    ("GPL-2.0", "header", "GNU General Public License Version 2, June 1991", "general 2"),
    ("GPL-3.0", "header", "GNU General Public License Version 3, 29 June 2007", "general 3"),
    ("LGPL-2.1", "header", "GNU Lesser General Public License Version 2.1, February 1999", "lesser general 2.1"),
    ("LGPL-3.0", "header", "GNU Lesser General Public License Version 3, 29 June 2007", "lesser general 3"),
    ("AGPL-3.0", "header", "GNU Affero General Public License Version 3, 19 November 2007", "affero general 3"),
    ("MPL-2.0", "header", "Mozilla Public License Version 2.0", "mozilla 2.0"),
    ("EPL-2.0", "named", "Licensed under the Eclipse Public License, Version 2.0.", "eclipse 2.0"),
    ("EPL-2.0", "header", "Eclipse Public License - v 2.0", "eclipse public license 2.0"),
    ("EPL-1.0", "named", "Licensed under the Eclipse Public License, Version 1.0.", "eclipse 1.0"),
    ("EUPL-1.2", "named", "Licensed under the EUPL, Version 1.2.", "eupl 1.2"),
    ("EUPL-1.2", "header", "European Union Public Licence v. 1.2", "european union public 1.2"),
    ("Zlib", "named", "Released under the zlib License.", "zlib"),
    (
        "Zlib",
        "grant",
        "This software is provided 'as-is', without any express or implied warranty. In no event will "
        "the authors be held liable for any damages arising from the use of this software. Permission "
        "is granted to anyone to use this software for any purpose, including commercial applications, "
        "and to alter it and redistribute it freely, subject to the following restrictions:",
        "",
    ),
):
    TEMPLATES[f"{_name}-{_kind}"] = _text
    if _must:
        NEEDED[f"{_name}-{_kind}"] = _must
for _name in (
    "MIT ISC Zlib Unlicense Apache-2.0 MPL-2.0 EPL-1.0 EPL-2.0 EUPL-1.2 CC0-1.0 BSD-2-Clause BSD-3-Clause "
    "GPL-2.0 GPL-3.0 LGPL-2.1 LGPL-3.0 AGPL-3.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0"
).split():
    _ends = {"spdx": ""} | ({"spdx-only": "-only", "spdx-later": "-or-later"} if "GPL" in _name else {})
    for _kind, _end in _ends.items():
        _text = f"SPDX-License-Identifier: {_name}{_end}"
        TEMPLATES[f"{_name}-{_kind}"] = _text
        NEEDED[f"{_name}-{_kind}"] = _text.lower().replace("-", " ").replace(":", "")


def license_of(template: str) -> str:
    """The license a template names; of a template of one's own, its name."""
    if template in TEMPLATES:
        for kind in KINDS:
            template = template.removesuffix(f"-{kind}")
    return template


# Words that make another license of a short form if they stand within it.
OTHERWISE = frozenset(
    "lesser library affero nc sa nd noncommercial sharealike noderivatives noderivs commercial "
    "derivatives alike clause".split()
)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def longest_rising(values: list[int]) -> list[int]:
    """Places of a longest strictly rising subsequence, by patience sorting."""
    tops: list[int] = []
    top_places: list[int] = []
    before = [-1] * len(values)
    for i, value in enumerate(values):
        pile = bisect_left(tops, value)
        before[i] = top_places[pile - 1] if pile else -1
        tops[pile : pile + 1] = [value]
        top_places[pile : pile + 1] = [i]
    places = []
    at = top_places[-1] if top_places else -1
    while at >= 0:
        places.append(at)
        at = before[at]
    return places[::-1]


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence as pairs of places."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(len(b) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if a[i] == b[j] else max(below[j], row[j + 1])
    pairs, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return pairs


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places of ``a`` and ``b``, rising in both."""
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {word: j for j, word in enumerate(b[b0:b1], b0) if in_b[word] == 1}
        anchors = [(i, place[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and a[i] in place]
        anchors = [anchors[k] for k in longest_rising([j for _, j in anchors])]
        if not anchors:
            if in_a.keys() & in_b.keys():
                pairs += [(a0 + i, b0 + j) for i, j in _common(a[a0:a1], b[b0:b1])]
            continue
        pairs += anchors
        for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)]):
            todo.append((i + 1, k, j + 1, m))
    return sorted(pairs)


class Scanner:
    def __init__(self, templates: dict[str, str], least: float = LEAST_COVERAGE):
        self.least = least
        # Given templates have no words of their own that must be matched.
        self.must = {
            name: frozenset(words.split())
            for name, words in NEEDED.items()
            if templates.get(name) == TEMPLATES[name]
        }
        self.templates = {name: words_of(text) for name, text in templates.items()}
        self.templates = {name: words for name, words in self.templates.items() if words}
        vocabulary = sorted({word for words in self.templates.values() for word in words})
        self.numbers = {word: i for i, word in enumerate(vocabulary)}
        # A covered template lacks at most so many words; of any more of its words at least
        # one must be in the text. The longest ones are looked for.
        self.needles = {}
        for name, words in self.templates.items():
            counts = Counter(words)
            lacking, needles = len(words) - self.needed(name), []
            for word in sorted(counts, key=lambda w: (-len(w), w)):
                needles.append(word)
                lacking -= counts[word]
                if lacking < 0:
                    break
            self.needles[name] = needles

    def needed(self, name: str) -> int:
        return int(np.ceil(self.least * len(self.templates[name]) - 1e-9))

    def scan(self, text: str | None) -> list[tuple[str, float, list[tuple[int, int]]]]:
        """For each template found: its best coverage, and each copy's first word and the
        word behind its last."""
        lower = (text or "").lower()
        likely = [
            n
            for n, needles in self.needles.items()
            if all(w in lower for w in self.must.get(n, ())) and any(w in lower for w in needles)
        ]
        if not likely:
            return []
        words = WORD.findall(lower)
        numbers = np.fromiter((self.numbers.get(w, -1) for w in words), np.int64, len(words))
        copies = []
        for name in likely:
            template = self.templates[name]
            own = np.zeros(len(self.numbers) + 1, bool)
            own[[self.numbers[w] for w in template]] = True
            hits = own[numbers]  # -1 is the last place, which is of no template
            must = self.must.get(name, frozenset())
            for places in self._copies(words, hits, template, self.needed(name), must):
                copies.append((name, len(places) / len(template), places))
        found: dict[str, tuple[float, list[tuple[int, int]]]] = {}
        for name, coverage, places in self._best(words, copies):
            best, spans = found.get(name, (0.0, []))
            found[name] = max(best, coverage), [*spans, (places[0], places[-1] + 1)]
        return [(name, *found[name]) for name in likely if name in found]

    def _best(
        self, words: list[str], copies: list[tuple[str, float, list[int]]]
    ) -> list[tuple[str, float, list[int]]]:
        """The copies whose telling words (or most words, if none are) no better one has
        matched; better is what matches more words, or the same number of a shorter
        template. In order of their places."""
        taken: dict[int, set[int]] = {}  # for each word the better copies that match it
        kept = []
        for copy in sorted(copies, key=lambda c: (-len(c[2]), -c[1], c[2][0])):
            name, _, places = copy
            telling = [i for i in places if words[i] in self.must[name]] if name in self.must else places
            shared = Counter(k for i in telling for k in taken.get(i, ()))
            if shared and max(shared.values()) >= LEAST_COVERAGE * len(telling):
                continue
            for i in places:
                taken.setdefault(i, set()).add(len(kept))
            kept.append(copy)
        return sorted(kept, key=lambda c: c[2][0])

    @staticmethod
    def _copies(
        words: list[str],
        hits: np.ndarray,
        template: list[str],
        needed: int,
        must: frozenset[str] = frozenset(),
    ) -> list[list[int]]:
        """The places of the words matched, for each copy."""
        n = len(template)
        own = Counter(template)
        if (own & Counter(words)).total() < needed:
            return []
        span = max(int(SPAN * n), n + 1)
        longest = max(span, n + GAP * (n - 1))
        otherwise = OTHERWISE - own.keys() if must else frozenset()
        found: list[list[int]] = []

        def starts(span: int) -> list[int]:
            before = np.concatenate([[0], np.cumsum(hits)])
            ends = np.minimum(np.arange(len(words)) + span, len(words))
            return np.flatnonzero(hits & (before[ends] - before[:-1] >= needed)).tolist()

        def chain(start: int, length: int) -> list[tuple[int, int]]:
            """The pairs from ``start`` on, up to too wide a gap."""
            pairs = align(words[start : start + length], template)
            for at, ((i, j), (k, m)) in enumerate(zip(pairs, pairs[1:]), 1):
                if k - i - (m - j) > GAP:
                    return pairs[:at]
            return pairs

        def covers(start: int, pairs: list[tuple[int, int]]) -> bool:
            if len(pairs) < needed or pairs[0][0]:
                return False
            if not must:
                return True
            inside = words[start : start + pairs[-1][0] + 1]
            return must <= {template[j] for _, j in pairs} and otherwise.isdisjoint(inside)

        def settled(start: int, pairs: list[tuple[int, int]], length: int, room: int) -> int:
            """Adds the copy found, from a later word or with further words if more match."""
            best, lead = pairs, start
            if len(pairs) < n:
                for i, _ in [(0, 0), *pairs[1 : n - len(pairs) + 1]]:
                    more = chain(start + i, min(length + GAP, room - i))
                    if len(more) > len(best) and covers(start + i, more):
                        best, lead = more, start + i
            found.append([lead + i for i, _ in best])
            return found[-1][-1] + 1

        behind = 0
        for start in starts(span):
            stretch = words[start : start + span]
            if start < behind or (own & Counter(stretch)).total() < needed:
                continue
            pairs = align(stretch, template)
            if covers(start, pairs):
                behind = settled(start, pairs, span, len(words) - start)
        # Copies with more words inserted, in what is left.
        hits = hits.copy()
        for places in found:
            hits[places[0] : places[-1] + 1] = False
        firsts = set(template[: n - needed + 1])
        taken = [places[0] for places in found]
        behind = 0
        for start in starts(longest):
            if start < behind or words[start] not in firsts:
                continue
            k = bisect_left(taken, start)
            room = min(longest, (taken[k] if k < len(taken) else len(words)) - start)
            if (own & Counter(words[start : start + room])).total() < needed:
                continue
            length = min(span, room)
            while True:
                if (own & Counter(words[start : start + length])).total() >= needed:
                    pairs = chain(start, length)
                    if covers(start, pairs):
                        behind = settled(start, pairs, length, room)
                        break
                if length == room:
                    break
                length = min(length + max(GAP, length // 2), room)
        return sorted(found)


def scan_licenses(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: float = LEAST_COVERAGE,
) -> DataFrame:
    """A row for each document and template covered by at least ``least``: ``license``,
    ``template``, ``coverage``, ``n_copies``, and ``spans``, the first word and the one behind the last of
    each copy, counted in words from 0."""
    shared = share(docs.sparkSession, (templates or TEMPLATES, least))

    def work(batches: Iterator[dict[str, list]]) -> Iterator[list]:
        scanner = per_worker(shared, lambda given: Scanner(*given))
        for batch in batches:
            out = [
                (doc_id, license_of(name), name, coverage, len(copies), [{"first": a, "behind": b} for a, b in copies])
                for doc_id, text in zip(batch[id_col], batch[text_col])
                for name, coverage, copies in scanner.scan(text)
            ]
            yield list(zip(*out)) if out else [[]] * 6

    return map_rows(
        docs.select(id_col, text_col),
        f"`{id_col}` {type_of(docs, id_col)}, license string, template string, coverage double, "
        "n_copies long, spans array<struct<first: long, behind: long>>",
        work,
    )
