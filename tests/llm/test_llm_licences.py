"""Licence texts as they are met: headings, identifiers, clauses, versions, holders, pages."""

from __future__ import annotations

from cladeframe.llm import licenses

SCHEMA = "doc_id long, path string, text string"
BODY = "\n\nThe quick brown fox jumps over the lazy dog near the river bank.\n"


def found(spark, texts):
    rows = [(i, f"f{i}/x", t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["licence"] for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    return [got[i] for i in range(len(texts))]


def test_headings_of_licence_texts(spark):
    texts = {
        "GPL-3.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n                            Preamble\n",
        "Apache-2.0": "\n                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n",
        "MPL-2.0": "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n",
        "GFDL-1.3": "                GNU Free Documentation License\n                 Version 1.3, 3 November 2008\n",
        "LGPL-2.0": "                  GNU LIBRARY GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n",
    }
    assert found(spark, [t + BODY for t in texts.values()]) == list(texts)


def test_identifiers(spark):
    texts = {
        "# SPDX-License-Identifier: Apache-2.0\nimport os\n": "Apache-2.0", "// SPDX-License-Identifier: MIT\n": "MIT", "/* SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note */\n": "GPL-2.0 WITH Linux-syscall-note",
        "# SPDX-License-Identifier: (MIT OR Apache-2.0)\n": "MIT OR Apache-2.0", "# SPDX-License-Identifier: Foo-1.0\n": "unknown", "# SPDX-License-Identifier: LGPL-2.1-or-later\n": "LGPL-2.1",
        "The identifier of the license is not told.\n": None,
    }
    assert found(spark, [t + BODY for t in texts]) == list(texts.values())


def test_clauses_and_versions(spark):
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT-0" and len(t) > 300)
    texts = [
        (licenses.BSD + licenses.BSD_4 + licenses.BSD_AS_IS, "BSD-4-Clause"), (licenses.BSD + licenses.BSD_3 + licenses.BSD_AS_IS, "BSD-3-Clause"), (licenses.BSD + licenses.BSD_AS_IS, "BSD-2-Clause"),
        (licenses.GRANT + ".\n\n" + licenses.NO_WARRANTY, "0BSD"), (licenses.GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + licenses.NO_WARRANTY, "ISC"), (mit, "MIT-0"),
        (licenses.GNU.format("", "7"), "GPL-unknown"), ("Licensed under the Apache License 2004.", "Apache-2.0"), ("Licensed under CC BY-NC-SA 3.0.", "CC-BY-NC-SA-3.0"), ("Licensed under CC BY-SA 9.0.", "CC-BY-SA-unknown"),
    ]
    assert found(spark, [t for t, _ in texts]) == [name for _, name in texts]


def test_reserved_rights(spark):
    bsd = licenses.BSD + licenses.BSD_3 + licenses.BSD_AS_IS
    texts = [
        "Copyright (c) 2020 Foo. All rights reserved.", "Copyright 1999-2001 Some Company Ltd.\nAll rights reserved." + BODY, "Copyright (c) 2020, Foo\nAll rights reserved.\n\n" + bsd, "Copyright (c) The Regents. All rights reserved.\n\n" + bsd,
        "Copyright (c) 2020 Foo Bar\n" + BODY,
    ]
    assert found(spark, texts) == ["proprietary", "proprietary", "BSD-3-Clause", "BSD-3-Clause", None]


def test_pages_inherit_along_their_addresses(spark):
    rows = [
        (1, "https://a.example.org/LICENSE.html?x=1", "<html><style>p{}</style><body><p>Licensed under CC BY-SA 4.0.</p></body></html>"), (2, "https://a.example.org/en/page#top", "<p>fox and dog</p>"),
        (3, "https://b.example.org/en/page", "<p>fox and dog</p>"), (4, None, "<p>fox</p>"), (5, "no address", None), (6, "http://a.example.org/x/y/z", None),
    ]
    pages = spark.createDataFrame([(*r, "other") for r in rows], "page_id long, url string, html string, path string")
    got = {r["doc_id"]: (r["licence"], r["origin"], r["source_path"]) for r in licenses.scan(licenses.as_pages(pages)).collect()}
    page = "a.example.org/LICENSE.html"
    assert got == {1: ("CC-BY-SA-4.0", "own", page), 2: ("CC-BY-SA-4.0", "inherited", page), 3: (None, "none", None), 4: (None, "none", None), 5: (None, "none", None), 6: ("CC-BY-SA-4.0", "inherited", page)}
    assert licenses.scan(licenses.as_pages(pages.limit(0))).count() == 0
