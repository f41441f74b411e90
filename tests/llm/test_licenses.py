from __future__ import annotations

import re
from itertools import combinations

from hypothesis import given, strategies as st

from basketry.llm.licenses import TEMPLATES, find_licenses, patience, scan_licenses, templates
from tests.conftest import rows

SF = "/root/testdata/sf0.1"
MIT = TEMPLATES["MIT"][1]


@given(st.lists(st.sampled_from("abcdefg"), max_size=14), st.lists(st.sampled_from("abcdefg"), max_size=14))
def test_alignment_is_increasing_and_equal(a, b):
    found = patience(a, b)
    assert all(a[i] == b[j] for i, j in found)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:], strict=False))


def test_alignment_of_unique_words_is_longest():
    """With all words unique, the alignment is the longest common subsequence."""
    a, b = "a b c d e f g h".split(), "c a d f b g e h".split()
    best = max(n for n in range(9) for pick in combinations(a, n) if _subsequence(pick, b))
    assert len(patience(a, b)) == best


def _subsequence(words, text):
    text = iter(text)
    return all(w in text for w in words)


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lines = {
        "MIT": "released under the mit license",
        "Apache-2.0": "licensed under the apache license version 2.0",
        "GPL-3.0": "this work is licensed under the gnu general public license version 3",
        "CC-BY-NC-4.0": "licensed under cc by-nc 4.0",
        "all-rights-reserved": "all rights reserved",
    }
    expected = set()
    for r in docs.collect():
        text = " ".join(re.sub(r"[^\w. -]", " ", r.text).lower().split())
        expected |= {(r.doc_id, name) for name, line in lines.items() if line in text}
    found = scan_licenses(docs).collect()
    assert {(r.doc_id, r.license) for r in found} == expected and len(expected) > 200


def test_edited_and_broken_lines():
    known = templates()
    words = MIT.split()
    edited = " ".join(w for n, w in enumerate(words) if n % 8)
    wrapped = "\n * ".join(" ".join(words[at : at + 9]) for at in range(0, len(words), 9))
    for text in (MIT, MIT.upper(), edited, f"// {wrapped}", f"before {MIT} after"):
        assert [f[0] for f in find_licenses(text, known)] == ["MIT"], text
    assert find_licenses(" ".join(words[: len(words) // 2]), known) == []
    assert find_licenses("the driving license is under the chair", known) == []
    twice = find_licenses(f"{MIT} {'and so on ' * 40} {MIT} Released under the MIT License.", known)
    assert [f[0] for f in twice] == ["MIT", "MIT", "MIT"]


def test_edges(documents, clashing, prose):
    long = prose(30_000, 1) + " Released under the MIT License. " + prose(10, 2)
    docs = documents((1, None), (2, ""), (None, "All rights reserved."), (3, long), (3, long), (4, "é — Licensed under CC BY-NC 4.0"))
    found = rows(scan_licenses(clashing(docs)), "doc_id", "license", "start", "found")
    assert found == [
        (None, "all-rights-reserved", 1, "All rights reserved"),
        (3, "MIT", long.index("Released") + 1, "Released under the MIT License"),
        (3, "MIT", long.index("Released") + 1, "Released under the MIT License"),
        (4, "CC-BY-NC-4.0", 5, "Licensed under CC BY-NC 4.0"),
    ]
    assert scan_licenses(docs.limit(0)).count() == 0
    assert scan_licenses(docs, {}).count() == 0


def test_siblings_against_their_neighbours():
    """Each wording is found under its own name alone, whatever its siblings say."""
    known = templates()
    for name, wordings in TEMPLATES.items():
        for wording in wordings:
            assert [f[0] for f in find_licenses(f"before it {wording} after it", known)] == [name], wording
    lines = {
        "Licensed under CC BY 4.0": ["CC-BY-4.0"],
        "Licensed under CC BY-SA 4.0": ["CC-BY-SA-4.0"],
        "Licensed under CC BY-NC-ND 4.0": ["CC-BY-NC-ND-4.0"],
        "Licensed under CC BY NC 4.0": ["CC-BY-NC-4.0"],
        "Licensed under CC BY-NC 3.0": ["CC-BY-NC-3.0"],
        "Licensed under CC BY-NC 5.0": [],
        "Released under the BSD License": ["BSD"],
        "Released under the Artistic License": [],
        "This work is licensed under the GNU General Public License, version 2": ["GPL-2.0"],
        "This work is licensed under the GNU General Public License v3.0": ["GPL-3.0"],
        "This work is licensed under the GNU General Public License, version 4": [],
        "This work is licensed under the GNU Lesser General Public License, version 3": ["LGPL-3.0"],
        "This work is licensed under the GNU Affero General Public License, version 3": ["AGPL-3.0"],
        "Licensed under the Mozilla Public License, Version 2.0": ["MPL-2.0"],
        "Licensed under the MIT License": ["MIT"],
        "SPDX-License-Identifier: MIT": ["MIT"],
        "// SPDX-License-Identifier: GPL-2.0-only": ["GPL-2.0"],
        "# SPDX-License-Identifier: GPL-3.0-or-later": ["GPL-3.0"],
        "/* SPDX-License-Identifier: LGPL-2.1+ */": ["LGPL-2.1"],
        "SPDX-License-Identifier: BSD-3-Clause": ["BSD-3-Clause"],
        "SPDX-License-Identifier: Proprietary": [],
        "SPDX-License-Identifier: CC-BY-SA-4.0": ["CC-BY-SA-4.0"],
        "MIT Licensed": ["MIT"],
        "Licensed under Apache 2.0": ["Apache-2.0"],
        "Licensed under the Apache 2.0 license": ["Apache-2.0"],
        "Licensed under Apache 3.0": [],
        "GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007": ["GPL-3.0"],
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991": ["GPL-2.0"],
        "This is free and unencumbered software released into the public domain.": ["Unlicense"],
        "Licensed under the Eclipse Public License, Version 2.0": ["EPL-2.0"],
        "Licensed under the Eclipse Public License, Version 1.0": ["EPL-1.0"],
        "Released under the zlib license": ["Zlib"],
        "Distributed under the Boost Software License, Version 1.0.": ["BSL-1.0"],
        "Licensed under the Artistic License 2.0": ["Artistic-2.0"],
        "It is not released under the MIT License": [],
        "This file isn't licensed under the Apache License, Version 2.0": [],
        "This is no toy, it is never released under the MIT License.": [],
        "Copying is not. Released under the MIT License": ["MIT"],
    }
    for line, names in lines.items():
        assert [f[0] for f in find_licenses(line, known)] == names, line
    three = f"{TEMPLATES['BSD'][1]} 1. {TEMPLATES['BSD-2-Clause'][2].split(' This software')[0]} {TEMPLATES['BSD-3-Clause'][2]}"
    assert [f[0] for f in find_licenses(three, known)] == ["BSD", "BSD-3-Clause"]


def test_back_to_back():
    """Repeated lines are as many findings, with and without words that are not of the template."""
    known = templates()
    edited = {
        "Licensed under a CC BY-NC 4.0": "CC-BY-NC-4.0",
        "This work is licensed under the terms of the GNU Lesser General Public License, version 3": "LGPL-3.0",
        " ".join(w for n, w in enumerate(MIT.split()) if n % 8): "MIT",
    }
    lines = {wording: name for name, wordings in TEMPLATES.items() for wording in wordings} | edited
    for line, name in lines.items():
        for n in (2, 3, 6):
            text = f"before it {f'{line} ' * n}after it"
            found = find_licenses(text, known)
            assert [f[0] for f in found] == [name] * n, (line, n)
            assert all(p[2] <= q[1] for p, q in zip(found, found[1:], strict=False))
    several = "All rights reserved. All rights reserved. Licensed under CC BY 4.0. Licensed under CC BY-NC 4.0. All rights reserved."
    names = [f[0] for f in find_licenses(several, known)]
    assert names == ["all-rights-reserved", "all-rights-reserved", "CC-BY-4.0", "CC-BY-NC-4.0", "all-rights-reserved"]
    assert [f[0] for f in find_licenses("Licensed under CC BY-NC. Licensed under CC BY-NC 4.0", known)] == ["CC-BY-NC-4.0"]
