"""License scans by patience alignment of text windows with license templates.

Words that occur once in the window and once in the template are anchors; their longest increasing subsequence is
aligned, and the gaps between its members are aligned the same way, within themselves. The share of a template's words
that are aligned is its coverage.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from math import ceil, floor

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from basketry.llm.common import whole

COVERAGE = 0.8
_TOKEN = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")

_VERSION = re.compile(r"v?([0-9]+(?:\.[0-9]+)*?)(?:\.0)*")

_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files, to deal in the Software without restriction, including without limitation the rights to "
    "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so"
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ADVERTISING = (
    "All advertising materials mentioning features or use of this software must display the following acknowledgement: "
    "This product includes software developed by"
)
_ENDORSE = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission."
)


def _gnu(kind: str, version: str, month: str) -> tuple[str, ...]:
    name = f"GNU {kind}General Public License"
    free = f"This program is free software: you can redistribute it and/or modify it under the terms of the {name}"
    return (
        f"This work is licensed under the {name}, version {version}.",
        f"{free} as published by the Free Software Foundation, either version {version} of the License, or (at your "
        "option) any later version.",
        f"Licensed under the {name}, version {version}.",
        f"{free} version {version} as published by the Free Software Foundation.",
        f"{name} Version {version}, {month}",
    )


def _creative_commons(parts: str, version: str) -> tuple[str, ...]:
    long = {"BY": "Attribution", "NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives" if version == "4.0" else "NoDerivs"}
    name = "-".join(long[p] for p in parts.split("-"))
    ending = {"4.0": " International", "3.0": " Unported"}.get(version, "")
    work = f"This work is licensed under a Creative Commons {name} {version}{ending} License."
    short = f"Licensed under CC {parts} {version}."
    return tuple(dict.fromkeys((short, work, short.replace(parts, parts.replace("-", " ")), work.replace(name, name.replace("-", " ")))))


# Wordings of licenses, from their public texts. "BSD" stands for words that do not tell the number of clauses.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": ("Released under the MIT License.", _MIT, "MIT Licensed."),
    "MIT-0": ("Released under the MIT No Attribution License.", f"{_MIT}. The software is provided as is"),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under Apache 2.0.",
        "Licensed under the Apache 2.0 License.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "Apache-1.1": ("Licensed under the Apache Software License, Version 1.1.",),
    **{f"GPL-{v}": _gnu("", v.removesuffix(".0"), month) for v, month in (("1.0", "February 1989"), ("2.0", "June 1991"), ("3.0", "29 June 2007"))},
    **{f"LGPL-{v}": _gnu("Lesser ", v.removesuffix(".0"), month) for v, month in (("2.1", "February 1999"), ("3.0", "29 June 2007"))},
    "LGPL-2.0": _gnu("Library ", "2", "June 1991"),
    "AGPL-3.0": _gnu("Affero ", "3", "19 November 2007"),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    "MPL-1.1": (
        "Licensed under the Mozilla Public License, version 1.1.",
        "The contents of this file are subject to the Mozilla Public License Version 1.1",
    ),
    **{
        f"CC-{parts}-{v}": _creative_commons(parts, v)
        for parts in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND")
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0")
    },
    "CC0-1.0": ("Licensed under CC0 1.0.", "This work is licensed under a Creative Commons Zero 1.0 Universal License."),
    "BSD": (
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ),
    "BSD-2-Clause": (
        "Released under the BSD 2-Clause License.",
        "Released under the 2-Clause BSD License.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution. This software "
        "is provided by the copyright holders and contributors as is",
    ),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", "Released under the 3-Clause BSD License.", _ENDORSE),
    "BSD-4-Clause": (
        "Released under the BSD 4-Clause License.",
        "Released under the 4-Clause BSD License.",
        _ADVERTISING,
        f"{_ADVERTISING} the organization. {_ENDORSE}",
    ),
    "ISC": (
        "Released under the ISC License.",
        f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "0BSD": (
        "Released under the BSD Zero Clause License.",
        f"{_ISC}. The software is provided as is and the author disclaims all warranties with regard to this software",
    ),
    "Unlicense": ("Released under the Unlicense.", "This is free and unencumbered software released into the public domain."),
    **{
        f"EPL-{v}": (
            f"Licensed under the Eclipse Public License, version {v}.",
            f"This program and the accompanying materials are made available under the terms of the Eclipse Public License v{v}",
        )
        for v in ("1.0", "2.0")
    },
    "Zlib": (
        "Released under the zlib License.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not "
        "be misrepresented",
    ),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "Artistic-2.0": ("Licensed under the Artistic License 2.0.",),
    "all-rights-reserved": ("All rights reserved.",),
}
_MARK = "SPDX-License-Identifier"
# Licenses of the list above whose identifiers have several forms, and those without an identifier.
_FORMS_OF = {n: (n, f"{n}-only", f"{n}-or-later", f"{n}+") for n in ("GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")}
_UNLISTED = ("BSD", "all-rights-reserved")
for _name in TEMPLATES:
    if _name not in _UNLISTED:
        TEMPLATES[_name] += tuple(f"{_MARK}: {form}" for form in _FORMS_OF.get(_name, (_name,)))
# Words that name a license. Those of a template, and its version numbers, have to be aligned.
NAMES = frozenset(
    "mit attribution apache license-2.0 gnu lesser affero library mozilla isc bsd zero 2-clause 3-clause 4-clause cc cc0 creative "
    "unlicense unencumbered eclipse zlib boost artistic".split()
)
_KINDS = "nc sa nd noncommercial sharealike noderivatives noderivs non-commercial share-alike"
_FORMS = (
    "by-nc by-sa by-nd by-nc-sa by-nc-nd attribution-noncommercial attribution-sharealike attribution-noderivatives "
    "attribution-noderivs attribution-noncommercial-sharealike attribution-noncommercial-noderivatives "
    "attribution-noncommercial-noderivs attribution-non-commercial attribution-share-alike"
)
_CC = frozenset(["by", *_KINDS.split(), *_FORMS.split(), "attribution", "zero"])
_GNU = frozenset(["lesser", "affero", "library"])
_BSD = frozenset(["2-clause", "3-clause", "4-clause", "0-clause", "zero"])
# Of a template that holds the words before them, the words that have to be aligned, where it has them, and
# those that make another license of it: they may not stand unaligned between its aligned words.
SIBLINGS: tuple[tuple[frozenset[str], frozenset[str], frozenset[str]], ...] = (
    (frozenset(["cc"]), _CC, _CC),
    (frozenset(["creative", "commons"]), _CC, _CC),
    (frozenset(["gnu"]), _GNU, _GNU),
    (frozenset(["bsd"]), _BSD, _BSD),
    (frozenset(["mit"]), frozenset(["attribution"]), frozenset(["attribution"])),
    (frozenset(["furnished", "provided"]), frozenset(["provided"]), frozenset(["subject", "conditions"])),
    (frozenset(["fee", "copies"]), frozenset(["copies"]), frozenset(["supporting"])),
    (frozenset(["fee", "disclaims"]), frozenset(["disclaims"]), frozenset(["copies", "appear", "supporting"])),
    (frozenset(["materials", "distribution"]), frozenset(["contributors"]), frozenset(["neither", "endorse", "advertising"])),
    (frozenset(["advertising", "endorse"]), frozenset(["advertising", "endorse"]), frozenset()),
    # An identifier is one word, and tells the license by itself.
    (frozenset([_MARK.lower()]), frozenset(f.lower().removesuffix("+") for n in TEMPLATES for f in _FORMS_OF.get(n, (n,))), frozenset()),
)
# Words that deny the license named after them, and those that a "t" after them makes so.
_DENIALS = frozenset("not never neither nor".split())
_SHORTENED = frozenset("isn aren wasn weren".split())
_SENTENCE_END = re.compile(r"[.!?;:]\s|\n\s*\n")
# Words that are never the key of a template.
COMMON = frozenset("a all an and any are at be by can for in is it its may not of on or so that the this to under use whom with work you your".split())


def words(text: str) -> list[tuple[str, int, int]]:
    """Words in lower case, each with its place in the text. A number is written as a version: ``v2.0`` is ``2``."""
    found = []
    for m in _TOKEN.finditer(text):
        word = m.group().lower()
        if word[-1].isdigit() and (version := _VERSION.fullmatch(word)):
            word = version.group(1)
        found.append((word, m.start(), m.end()))
    return found


@dataclass(frozen=True, eq=False)
class Template:
    """``keys``: so many of its words, with their offsets, that a text without any of them covers too little of it.

    ``needed``: offsets of the words that tell it from other licenses, ``barred``: words that make it another one.
    """

    license: str
    words: tuple[str, ...]
    keys: Mapping[str, tuple[int, ...]]
    needed: frozenset[int]
    barred: frozenset[str]


def templates(texts: Mapping[str, Sequence[str]] = TEMPLATES, coverage: float = COVERAGE) -> list[Template]:
    """A word that has to be aligned is the only key of its template."""
    found = []
    for name, wordings in texts.items():
        for wording in wordings:
            each = tuple(w for w, _, _ in words(wording))
            if not each:
                continue
            near = [siblings for siblings in SIBLINGS if siblings[0] <= set(each)]
            telling = NAMES.union(*(needed for _, needed, _ in near))
            needed = frozenset(i for i, w in enumerate(each) if w in telling or _VERSION.fullmatch(w))
            missing = floor(len(each) * (1 - coverage) + 1e-9) + 1
            order = sorted(range(len(each)), key=lambda i: (each[i] in COMMON, -len(each[i]), i))
            if spelled := [i for i in order if i in needed and not _VERSION.fullmatch(each[i])]:
                order, missing = spelled, 1
            chosen = {each[i] for i in order[:missing]}
            keys = {k: tuple(i for i, w in enumerate(each) if w == k) for k in sorted(chosen)}
            found.append(Template(name, each, keys, needed, frozenset().union(*(barred for _, _, barred in near))))
    return found


def patience(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int]]:
    """Aligned places of two word lists, increasing in both."""
    aligned: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        a_low, a_high, b_low, b_high = gaps.pop()
        while a_low < a_high and b_low < b_high and a[a_low] == b[b_low]:
            aligned.append((a_low, b_low))
            a_low, b_low = a_low + 1, b_low + 1
        while a_low < a_high and b_low < b_high and a[a_high - 1] == b[b_high - 1]:
            a_high, b_high = a_high - 1, b_high - 1
            aligned.append((a_high, b_high))
        in_a, in_b = Counter(a[a_low:a_high]), Counter(b[b_low:b_high])
        place = {b[j]: j for j in range(b_low, b_high) if in_b[b[j]] == 1}
        pairs = [(i, place[a[i]]) for i in range(a_low, a_high) if in_a[a[i]] == 1 and a[i] in place]
        chain = _increasing(pairs)
        if not chain:
            continue
        edges = [(a_low - 1, b_low - 1), *chain, (a_high, b_high)]
        aligned += chain
        for (i, j), (k, m) in zip(edges, edges[1:], strict=False):
            if k - i > 1 and m - j > 1:
                gaps.append((i + 1, k, j + 1, m))
    return sorted(aligned)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of ``pairs`` (sorted by the first) that increases in the second: patience sorting."""
    tops: list[int] = []
    heads: list[int] = []
    back: list[int] = []
    for at, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        back.append(heads[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(j)
            heads.append(at)
        else:
            tops[pile], heads[pile] = j, at
    chain, at = [], heads[-1] if heads else -1
    while at >= 0:
        chain.append(pairs[at])
        at = back[at]
    return chain[::-1]


def _told(aligned: Sequence[tuple[int, int]], text: Sequence[str], template: Template) -> bool:
    """Whether the words that tell the license from its siblings are aligned, and none of a sibling stands between."""
    if not template.needed <= {j for _, j in aligned}:
        return False
    if not template.barred:
        return True
    places = {i for i, _ in aligned}
    return not any(text[i] in template.barred and i not in places for i in range(aligned[0][0], aligned[-1][0]))


def _best(each: Sequence[str], template: Template, begin: int, low: int, high: int, coverage: float) -> tuple[int, int, int] | None:
    """(first, last, aligned words) of the template in ``each[low:high]``, sought first where it would begin, then around.

    A window that holds parts of a neighbour loses words that are no longer unique; of several windows the one with
    most aligned words counts, then the one with the shortest finding.
    """
    size = len(template.words)
    slack = ceil(size / 4) + 2
    wide = max(low, begin - slack), min(high, begin + size + slack)
    least = coverage * size - 1e-9
    around = each[wide[0] : wide[1]]
    if sum((Counter(around) & Counter(template.words)).values()) < least:
        return None
    tight = max(low, begin), min(high, begin + size)
    best = None
    for start, end in dict.fromkeys((tight, wide, (wide[0], tight[1]), (tight[0], wide[1]))):
        window = each[start:end]
        aligned = patience(window, template.words)
        if not aligned or len(aligned) < least or not _told(aligned, window, template):
            continue
        one = start + aligned[0][0], start + aligned[-1][0], len(aligned)
        if best is None or (one[2], one[0] - one[1]) > (best[2], best[0] - best[1]):
            best = one
        if one[2] == size and one[1] - one[0] == size - 1:
            break
    return best


def find_licenses(text: str, known: Sequence[Template], coverage: float = COVERAGE) -> list[tuple[str, int, int, int, int]]:
    """(license, start, end, words of the template, aligned words) in the order of the text; starts count from 0.

    Each occurrence of a key says where its template would begin. Of findings that overlap, the one with most aligned
    words stays, then the shortest; what it leaves of the windows around it is searched again. The words that tell a
    template from other licenses have to be aligned, and words that make it another one may not stand between. A finding
    that one of the two words before it denies is left out.
    """
    found = words(text)
    each = [w for w, _, _ in found]
    places: dict[str, list[int]] = {}
    wanted = {k for t in known for k in t.keys} | {t.words[i] for t in known for i in t.needed}
    for at, word in enumerate(each):
        if word in wanted:
            places.setdefault(word, []).append(at)
    # A key and where the template would begin; all windows at first, then those that a finding cut.
    open_: list[tuple[int, int, Template]] = []
    for template in known:
        if all(template.words[i] in places for i in template.needed):
            open_ += [(at, at - offset, template) for key, offsets in template.keys.items() for at in places.get(key, ()) for offset in offsets]
    kept: list[tuple[int, int, int, Template]] = []  # by place, without overlaps
    while open_:
        seen, later = {}, []
        starts, ends = [k[0] for k in kept], [k[1] for k in kept]
        for at, begin, template in open_:
            next_ = bisect_left(ends, at)
            if next_ < len(kept) and starts[next_] <= at:
                continue
            low, high = ends[next_ - 1] + 1 if next_ else 0, starts[next_] if next_ < len(kept) else len(each)
            place = id(template), begin, low, high
            if place not in seen:
                seen[place] = _best(each, template, begin, low, high, coverage)
            later.append((at, begin, template, seen[place]))
        added: list[tuple[int, int, int, Template]] = []
        firsts: list[int] = []
        for first, last, aligned, template in sorted(
            {(*one, template) for _, _, template, one in later if one},
            key=lambda f: (-f[2], f[1] - f[0], -f[2] / len(f[3].words), f[0], f[3].license),
        ):
            at = bisect_left(firsts, first)
            if (at == 0 or added[at - 1][1] < first) and (at == len(added) or added[at][0] > last):
                firsts.insert(at, first)
                added.insert(at, (first, last, aligned, template))
        if not added:
            break
        kept = sorted(kept + added, key=lambda k: k[0])
        lasts = [k[1] for k in added]
        open_ = []
        for at, begin, template, _ in later:
            reach = len(template.words) + ceil(len(template.words) / 4) + 2
            near = bisect_left(lasts, begin - reach)
            if near < len(added) and added[near][0] <= begin + reach:
                open_.append((at, begin, template))
    stated = [k for k in kept if not _denied(text, found, k[0])]
    return [(t.license, found[first][1], found[last][2], len(t.words), aligned) for first, last, aligned, t in stated]


def _denied(text: str, found: Sequence[tuple[str, int, int]], first: int) -> bool:
    """Whether one of the two words before a finding, in its sentence, denies it."""
    for back in range(max(0, first - 2), first):
        word = found[back][0]
        denies = word in _DENIALS or (word == "t" and back > 0 and found[back - 1][0] in _SHORTENED)
        if denies and not _SENTENCE_END.search(text, found[back][2], found[first][1]):
            return True
    return False


def scan_licenses(
    docs: DataFrame,
    texts: Mapping[str, Sequence[str]] = TEMPLATES,
    coverage: float = COVERAGE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """A row per license found: ``doc_id``, ``license``, ``start``, ``end``, ``n_words``, ``n_aligned``, ``coverage``, ``found``.

    ``start`` counts code points from 1, ``end`` is the last one, ``found`` the text between. A null text has no
    license; null ids are kept; repeated rows have repeated findings; an empty table has an empty result; other
    columns are not read. Whole texts are scanned where they lie; those without any key word are skipped by Spark.
    """
    known = templates(texts, coverage)
    keys = sorted({k for t in known for k in t.keys})
    rows = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    pattern = rf"(?<![a-z0-9])(?:{'|'.join(re.escape(k) for k in keys)})(?![a-z0-9])"
    rows = rows.where(F.lower("text").rlike(pattern) if keys else F.lit(False))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, found = [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                for name, start, end, size, aligned in find_licenses(text, known, coverage):
                    owners.append(row)
                    found.append((name, start + 1, end, size, aligned, aligned / size, text[start:end]))
            columns = list(zip(*found, strict=True)) or [()] * 7
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(owners, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["doc_id", "license", "start", "end", "n_words", "n_aligned", "coverage", "found"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        scan,
        f"doc_id {kind}, license string, start bigint, end bigint, n_words int, n_aligned int, coverage double, found string",
    )
