"""SPDX expressions and names of licences with versions."""

import random

import pytest

from tramline.llm import license_scan as L

CASES = {
    "SPDX-License-Identifier: MIT": "mit",
    "SPDX-License-Identifier: MIT-0": "mit-0",
    "// SPDX-License-Identifier: BSD-3-Clause-Clear": "bsd-3-clause-clear",
    "# spdx-license-identifier: Apache-2.0 OR MIT": "apache-2.0,mit",
    "SPDX-License-Identifier: (GPL-2.0+ WITH Classpath-exception-2.0) AND (MIT OR ISC)": "gpl-2.0,isc,mit",
    "SPDX-License-Identifier: GPL-2.0-or-later WITH Linux-syscall-note": "gpl-2.0",
    "SPDX-License-Identifier: LGPL-2.1-only": "lgpl-2.1",
    "SPDX-License-Identifier: MIT. More words OR Zlib": "mit",
    "SPDX-License-Identifier: MIT\nAND Zlib": "mit",
    "SPDX-License-Identifier: CC-BY-SA-4.0": "cc-by,cc-by-sa",
    "SPDX-License-Identifier: Unknown-1.0 OR Zlib": "zlib",
    "SPDX-License-Identifier: MITX": "",
    "SPDX-License-Identifier:": "",
    "SPDX-License-Identifier: OR MIT": "",
    "SPDX-License-Identifier: MIT OR (Zlib": "mit,zlib",
    "spdx license identifier mit": "",
    "under the GPLv3 or later": "gpl-3.0",
    "LGPL v2.1": "lgpl-2.1",
    "AGPL version 3": "agpl-3.0",
    "GNU Lesser General Public License v2.1": "gpl,lgpl-2.1",
    "GNU General Public License v3": "gpl,gpl-3.0",
    "Apache License\n Version 2.0, January 2004\n TERMS AND CONDITIONS": "apache-2.0",
}


def test_cases(spark):
    df = spark.createDataFrame([(i, f"é {t} end" if "\n" not in t and not t.endswith(":") else t) for i, t in enumerate(CASES)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in L.scan_licenses(df).collect()}
    assert {t: got[i] for i, t in enumerate(CASES)} == CASES


def test_an_expression_s_place_is_that_of_its_mark(spark):
    r = L.scan_licenses(spark.createDataFrame([(1, "one two\nSPDX-License-Identifier: MIT OR Zlib")], "doc_id long, text string")).first()
    assert [(p.word, p.label) for p in r.places] == [(2, "mit"), (2, "zlib")] and r.n_base == 0 and r.score == pytest.approx(0.99)


def test_random_expressions():
    """Expressions written from a tree give the tree's identifiers, in order."""
    rng = random.Random(4)
    names = ["mit", "zlib", "gpl-2.0+", "isc", "0bsd", "mit-0"]

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            n = rng.choice(names)
            return (n + " with some-exception" if rng.random() < 0.2 else n), [n.removesuffix("+").encode()]
        (a, x), (b, y) = tree(depth - 1), tree(depth - 1)
        joined = f"{a} {rng.choice(['and', 'or'])} {b}"
        return (f"({joined})" if rng.random() < 0.5 else f"( {joined} )"), x + y

    for _ in range(500):
        text, ids = tree(4)
        assert L.spdx_expressions(f"spdx-license-identifier: {text}\nmit".encode()) == [(0, ids)], text


def test_only_whole_texts_weigh_one():
    assert {label for label, w, _ in L.TEMPLATES if w == L.WHOLE} == {"mit", "bsd-2-clause", "bsd-3-clause", "isc", "0bsd", "zlib", "bsl-1.0", "unlicense"}
